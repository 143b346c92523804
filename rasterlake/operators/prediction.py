"""Prediction filters, runs and flips over rows of pixels. Windows are over one row of one image, never over more."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rasterlake.operators.resize import by_size

CHANNELS = ("r", "g", "b", "a")


def row() -> WindowSpec:
    return Window.partitionBy("image_id", "frame_idx", "y").orderBy("x")


def difference(c: str) -> Column:
    """A sample less its left neighbour, modulo 256: PNG's Sub filter and TIFF's horizontal predictor."""
    return F.pmod(F.col(c) - F.lag(c, 1, 0).over(row()), F.lit(256)).cast("int").alias(c)


def running(c: str) -> Column:
    """The inverse of difference."""
    return F.pmod(F.sum(c).over(row().rowsBetween(Window.unboundedPreceding, 0)), F.lit(256)).cast("int").alias(c)


def predicted(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "frame_idx", "y", "x", *map(difference, CHANNELS))


def unpredicted(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "frame_idx", "y", "x", *map(running, CHANNELS))


def column() -> WindowSpec:
    return Window.partitionBy("image_id", "frame_idx", "x").orderBy("y")


def filtered(pixels: DataFrame, kind: str) -> DataFrame:
    """PNG's filters 'up', 'average' and 'paeth' (difference is 'sub'): each sample less what its neighbours to the left, above,
    and above to the left foretell, modulo 256. Windows are over one row and one column."""
    near = pixels.withColumns({f"left_{c}": F.lag(c, 1, 0).over(row()) for c in CHANNELS})
    near = near.withColumns({f"up_{c}": F.lag(c, 1, 0).over(column()) for c in CHANNELS} | {f"corner_{c}": F.lag(f"left_{c}", 1, 0).over(column()) for c in CHANNELS})

    def foretold(c: str) -> Column:
        left, up, corner = F.col(f"left_{c}"), F.col(f"up_{c}"), F.col(f"corner_{c}")
        if kind == "up":
            return up
        if kind == "average":
            return F.floor((left + up) / 2)
        if kind != "paeth":
            raise ValueError("kind must be up, average or paeth")
        p = left + up - corner
        a, b, far = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
        return F.when((a <= b) & (a <= far), left).when(b <= far, up).otherwise(corner)

    return near.select("image_id", "frame_idx", "y", "x", *[F.pmod(F.col(c) - foretold(c), F.lit(256)).cast("int").alias(c) for c in CHANNELS])


def unfiltered_up(pixels: DataFrame) -> DataFrame:
    """The inverse of the filter 'up'."""
    total = lambda c: F.sum(c).over(column().rowsBetween(Window.unboundedPreceding, 0))
    return pixels.select("image_id", "frame_idx", "y", "x", *[F.pmod(total(c), F.lit(256)).cast("int").alias(c) for c in CHANNELS])


def foretold(kind: str, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What PNG's filter foretells of samples from their neighbours, all signed."""
    if kind == "sub":
        return left
    if kind == "up":
        return up
    if kind == "average":
        return (left + up) >> 1
    if kind != "paeth":
        raise ValueError("kind must be sub, up, average or paeth")
    p = left + up - corner
    a, b, far = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= far), left, np.where(b <= far, up, corner))


def _over_frames(frames: DataFrame, work) -> DataFrame:
    def run(rgba: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return by_size(rgba, w, h, work)

    return frames.withColumn("rgba", F.pandas_udf(run, "binary")("rgba", "width", "height"))


def filtered_frames(frames: DataFrame, kind: str) -> DataFrame:
    """frames with the samples of rgba filtered as `filtered` does, or by 'sub': narrow, as a frame has its rows at hand."""

    def work(px: np.ndarray) -> np.ndarray:
        wide = np.pad(px, ((0, 0), (1, 0), (1, 0), (0, 0))).astype(np.int16)
        return (px.astype(np.int16) - foretold(kind, wide[:, 1:, :-1], wide[:, :-1, 1:], wide[:, :-1, :-1])).astype(np.uint8)

    return _over_frames(frames, work)


def unfiltered_frames(frames: DataFrame, kind: str) -> DataFrame:
    """The inverse of filtered_frames. 'average' and 'paeth' need the sample to the left and the one above; so the places of one
    falling diagonal are made together, for all frames of a size."""

    def work(px: np.ndarray) -> np.ndarray:
        if kind in ("sub", "up"):
            return np.cumsum(px, axis=2 if kind == "sub" else 1, dtype=np.uint8)
        n, h, w, _ = px.shape
        wide = np.zeros((n, h + 1, w + 1, 4), dtype=np.int16)
        for d in range(h + w - 1):
            y = np.arange(max(0, d - w + 1), min(h, d + 1))
            x = d - y
            wide[:, y + 1, x + 1] = (px[:, y, x] + foretold(kind, wide[:, y + 1, x], wide[:, y, x + 1], wide[:, y, x])) & 255
        return wide[:, 1:, 1:].astype(np.uint8)

    return _over_frames(frames, work)


def packets(pixels: DataFrame, longest: int = 128) -> DataFrame:
    """Run-length packets of a row as Targa has them: image_id, frame_idx, y, x (start), n, raw. Runs of two or more equal pixels
    are packets of one pixel; single pixels in a row share a raw packet; none is longer than `longest`."""
    each = runs(pixels, longest).withColumn("raw", F.col("n") == 1)
    own = Window.partitionBy("image_id", "frame_idx", "y").orderBy("x")
    grouped = each.withColumn("island", F.sum((~F.col("raw")).cast("int")).over(own))
    inside = Window.partitionBy("image_id", "frame_idx", "y", "raw", "island").orderBy("x")
    part = F.when(F.col("raw"), F.floor((F.row_number().over(inside) - 1) / longest)).otherwise(0)
    return grouped.withColumn("part", part).groupBy("image_id", "frame_idx", "y", "raw", "island", "part").agg(F.min("x").alias("x"), F.sum("n").alias("n")).drop("island", "part")


def qoi_operations(pixels: DataFrame) -> DataFrame:
    """pixels with op, what QOI sends for each pixel of a frame in scan order: 'run' (as the one before), 'index' (the last one
    that its slot holds), 'diff', 'luma', 'rgb' or 'rgba'. Differences do not wrap around, and a pixel that is sent as a run does
    not enter its slot. The slots' state is a window over the pixels of one slot."""
    scan = Window.partitionBy("image_id", "frame_idx").orderBy("y", "x")
    in_slot = Window.partitionBy("image_id", "frame_idx", "slot").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, -1)
    word = F.struct(*CHANNELS)
    start, empty = F.struct(*[F.lit(v).alias(c) for c, v in zip(CHANNELS, (0, 0, 0, 255), strict=True)]), F.struct(*[F.lit(0).alias(c) for c in CHANNELS])
    known = pixels.withColumn("slot", color_slot(*map(F.col, CHANNELS)))
    known = known.withColumn("before", F.coalesce(F.lag(word).over(scan), start))
    known = known.withColumn("seen", F.coalesce(F.last(F.when(word != F.col("before"), word), ignorenulls=True).over(in_slot), empty))
    dr, dg, db = [F.col(c) - F.col(f"before.{c}") for c in "rgb"]
    op = (
        F.when(word == F.col("before"), "run")
        .when(word == F.col("seen"), "index")
        .when(F.col("a") != F.col("before.a"), "rgba")
        .when(dr.between(-2, 1) & dg.between(-2, 1) & db.between(-2, 1), "diff")
        .when(dg.between(-32, 31) & (dr - dg).between(-8, 7) & (db - dg).between(-8, 7), "luma")
        .otherwise("rgb")
    )
    return known.withColumn("op", op).drop("slot", "before", "seen")


def runs(pixels: DataFrame, longest: int = 128) -> DataFrame:
    """Run-length packets of equal pixels in a row, of at most `longest` pixels: image_id, frame_idx, y, x (start), n."""
    word = F.struct(*CHANNELS)
    starts = pixels.withColumn("new", F.coalesce((word != F.lag(word).over(row())).cast("int"), F.lit(1)))
    numbered = starts.withColumn("run", F.sum("new").over(row().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("image_id", "frame_idx", "y", "run").orderBy("x")
    split = numbered.withColumn("packet", F.floor((F.row_number().over(own) - 1) / longest))
    return split.groupBy("image_id", "frame_idx", "y", "run", "packet").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n")).drop("run", "packet")


def color_slot(r: Column, g: Column, b: Column, a: Column) -> Column:
    """QOI's slot of a colour among 64."""
    return (r * 3 + g * 5 + b * 7 + a * 11) % 64


def flipped(pixels: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Mirrored left to right if width is given, top to bottom if height is."""
    x = F.col("x") if width is None else width - 1 - F.col("x")
    y = F.col("y") if height is None else height - 1 - F.col("y")
    return pixels.withColumns({"x": x.cast("int"), "y": y.cast("int")})
