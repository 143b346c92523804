"""The image functions by name, for SQL. Detection, pixels and frames are SQL functions, which Spark inlines into its plans;
decoding, encoding and resizing work in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.formats import SIGNATURES
from rasterlake.operators.resize import MODES, resize_array

FRAME = "width INT, height INT, rgba BINARY"


def detection() -> str:
    """SQL for the format that the first bytes of `content` show."""
    cases = [f"WHEN length(content) >= {need} AND " + " AND ".join(f"substring(hex(substring(content, 1, 12)), {2 * at + 1}, {len(mark)}) = '{mark}'" for at, mark in marks.items()) + f" THEN '{kind}'" for kind, need, marks in SIGNATURES]
    return f"CASE {' '.join(cases)} END"


def number(at: int, size: int, little: bool) -> str:
    """SQL for an unsigned number in `content`."""
    digits = [f"hex(substring(content, {at + 1 + k}, 1))" for k in (reversed(range(size)) if little else range(size))]
    return f"cast(conv(concat({', '.join(digits)}), 16, 10) AS BIGINT)"


def sides() -> tuple[str, str]:
    """SQL for the width and the height in the headers of PNG, GIF, BMP and QOI files."""
    places = {"png": (16, 20, 4, False), "gif": (6, 8, 2, True), "bmp": (18, 22, 4, True), "qoi": (4, 8, 4, False)}
    return tuple("CASE image_detect(content) " + " ".join(f"WHEN '{k}' THEN {number(p[i], p[2], p[3])}" for k, p in places.items()) + " END" for i in (0, 1))


def register(spark: SparkSession) -> None:
    """Adds to the session: image_detect(content), image_info(content), image_decode(content, format),
    image_encode(rgba, width, height, format) and image_resize(rgba, width, height, new_width, new_height, mode), and the table
    functions image_pixels(rgba, width, height) and image_frames(frames). A file that cannot be decoded gives null."""
    from rasterlake.sources.codecs import ENCODERS, decode

    width, height = sides()
    for sql in (
        f"FUNCTION image_detect(content BINARY) RETURNS STRING RETURN {detection()}",
        f"FUNCTION image_info(content BINARY) RETURNS STRUCT<format STRING, width BIGINT, height BIGINT> RETURN named_struct('format', image_detect(content), 'width', {width}, 'height', {height})",
        """FUNCTION image_pixels(rgba BINARY, width INT, height INT) RETURNS TABLE (y INT, x INT, r INT, g INT, b INT, a INT)
        RETURN SELECT cast(k div width AS INT), k % width, cast(shiftright(w, 24) & 255 AS INT), cast(shiftright(w, 16) & 255 AS INT), cast(shiftright(w, 8) & 255 AS INT), cast(w & 255 AS INT)
        FROM (SELECT k, cast(conv(hex(substring(rgba, k * 4 + 1, 4)), 16, 10) AS BIGINT) AS w FROM (SELECT explode(sequence(0, width * height - 1)) AS k))""",
        """FUNCTION image_frames(frames ARRAY<STRUCT<width: INT, height: INT, duration_us: BIGINT, rgba: BINARY>>) RETURNS TABLE (frame_idx INT, width INT, height INT, duration_us BIGINT, rgba BINARY)
        RETURN SELECT pos, f.width, f.height, f.duration_us, f.rgba FROM (SELECT posexplode(frames) AS (pos, f))""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY {sql}")

    def pixels(b: bytes, w: int, h: int) -> np.ndarray:
        return np.frombuffer(b, dtype=np.uint8).reshape(int(h), int(w), 4)

    def resized(rgba: pd.Series, w: pd.Series, h: pd.Series, new_w: pd.Series, new_h: pd.Series, mode: pd.Series) -> pd.Series:
        out = []
        for b, *size, m in zip(rgba, w, h, new_w, new_h, mode, strict=True):
            if b is not None and (m not in MODES or min(size) <= 0):
                raise ValueError("sizes must be positive, mode one of " + ", ".join(MODES))
            out.append(None if b is None else resize_array(pixels(b, *size[:2])[None], int(size[3]), int(size[2]), m)[0].tobytes())
        return pd.Series(out, dtype=object)

    def decoded(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for d, k in zip(content, kind, strict=True):
            try:
                px = decode(k, d)
                out.append((px.shape[1], px.shape[0], px.tobytes()))
            except Exception:  # any malformed file
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["width", "height", "rgba"])

    def encoded(rgba: pd.Series, w: pd.Series, h: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else ENCODERS[k](pixels(b, x, y)) for b, x, y, k in zip(rgba, w, h, kind, strict=True)], dtype=object)

    spark.udf.register("image_resize", F.pandas_udf(resized, "binary"))
    spark.udf.register("image_decode", F.pandas_udf(decoded, FRAME))
    spark.udf.register("image_encode", F.pandas_udf(encoded, "binary"))
