"""Queries over BMP and TGA files made from the four-channel frames. Of a grey g a frame's channels are g, 255 - g, 7 g and 3 g."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made
from rasterlake.operators import bitmaps
from rasterlake.plans.tables import SIDE, emb_rgba

COLORS, FIRST = 200, 2


def channel(k: int, n: int) -> Column:
    return F.substring(F.hex("rgba"), k * 8 + 2 * n + 1, 2)


def laid(piece, up: bool, left: bool = False) -> Column:
    """The pixels' pieces from the bottom row up, or from the right to the left."""
    rows, cols = list(range(SIDE))[:: -1 if up else 1], list(range(SIDE))[:: -1 if left else 1]
    return F.concat(*[piece(y * SIDE + x) for y in rows for x in cols])


def of_variants(spark: SparkSession, sf_dir: str, variants: list[tuple[bytes, Column]]) -> DataFrame:
    content = F.lit(None).cast("binary")
    for k, (head, data) in enumerate(variants):
        content = F.when(F.col("image_id") % len(variants) == k, F.unhex(F.concat(F.lit(head.hex()), data))).otherwise(content)
    return emb_rgba(spark, sf_dir).select("image_id", made(content=content))


def bmp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the image's number modulo 6: 200 colours of 8 bits, 16 colours under an old header, 32 bits with masks from the top, 16
    bits, 24 bits under a short header, and the same without its last byte."""

    def file(info: bytes, palette: bytes = b"") -> bytes:
        start = 14 + len(info) + len(palette)
        return b"BM" + struct.pack("<IHHI", 0, 0, 0, start) + info + palette

    v3 = lambda depth, used: struct.pack("<IiiHHIIiiII", 40, SIDE, SIDE, 1, depth, 0, 0, 2835, 1000, used, 5)
    v4 = struct.pack("<IiiHHIIiiII4II", 108, SIDE, -SIDE, 1, 32, 3, 256, 0, 0, 0, 0, 0xFF, 0xFF00, 0xFF0000, 0, 1).ljust(108, b"\0")
    short = struct.pack("<IiiHH", 16, SIDE, SIDE, 1, 24)
    many = b"".join(bytes([i * 7 % 256, 255 - i, i, 0]) for i in range(COLORS))
    few = b"".join(bytes([255 - i, i * 3, i * 17]) for i in range(16))
    three = laid(lambda k: F.substring(F.hex("rgba"), k * 8 + 1, 6), True)
    return of_variants(spark, sf_dir, [
        (file(v3(8, COLORS), many), laid(lambda k: channel(k, 0), True)),
        (file(struct.pack("<IHHHH", 12, SIDE, SIDE, 1, 4), few), laid(lambda k: F.substring(F.hex("rgba"), k * 8 + 1, 1), True)),
        (file(v4), F.hex("rgba")),
        (file(v3(16, 0)), laid(lambda k: F.substring(F.hex("rgba"), k * 8 + 1, 4), True)),
        (file(short), three),
        (file(short), F.substring(three, 1, SIDE * SIDE * 6 - 2)),
    ])


def tga_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the image's number modulo 4: 200 colours of which the first two are skipped, from the bottom left; 16 bits with alpha
    from the top right; grey and alpha from the bottom right; and runs."""
    head = lambda kind, depth, flags, n=0, first=0: struct.pack("<BBBHHBHHHHBB", 3, int(n > 0), kind, first, n, 24 if n else 0, 0, 0, SIDE, SIDE, depth, flags) + b"abc"
    many = b"".join(bytes([i * 7 % 256, 255 - i, i]) for i in range(COLORS))
    return of_variants(spark, sf_dir, [
        (head(1, 8, 0, COLORS, FIRST) + many, laid(lambda k: channel(k, 0), True)),
        (head(2, 16, 0x31), laid(lambda k: F.substring(F.hex("rgba"), k * 8 + 1, 4), False, True)),
        (head(3, 16, 0x18), laid(lambda k: F.concat(channel(k, 0), channel(k, 3)), True, True)),
        (head(10, 32, 0x28), F.concat(F.lit("BF"), F.substring(F.hex("rgba"), 1, 8))),
    ])


QUERIES = {
    "bmp_headers": lambda s, d: bitmaps.bmp_images(bmp_files(s, d)).drop("content"),
    "bmp_palettes": lambda s, d: bitmaps.bmp_palettes(bmp_files(s, d)),
    "bmp_pixels": lambda s, d: bitmaps.bmp_pixels(bmp_files(s, d)),
    "tga_headers": lambda s, d: bitmaps.tga_images(tga_files(s, d)).drop("content"),
    "tga_pixels": lambda s, d: bitmaps.tga_pixels(tga_files(s, d)),
}


def sql(emb: str) -> dict[str, str]:
    by = lambda *values: f"[{', '.join(map(str, values))}][v + 1]"
    long = lambda name, *values: f"{by(*values)}::BIGINT AS {name}"
    none = "NULL"
    bmp = [
        f"{by(*[repr(k) for k in ('v3', 'core', 'v4', 'v3', 'os2 short', 'os2 short')])} AS kind", long("header_size", 40, 12, 108, 40, 16, 16), "8::BIGINT AS width", "8::BIGINT AS height", "v <> 2 AS bottom_up", "1::BIGINT AS planes", long("depth", 8, 4, 32, 16, 24, 24), long("compression", 0, 0, 3, 0, 0, 0),
        long("image_size", 0, none, 256, 0, none, none), long("x_per_meter", 2835, none, 0, 2835, none, none), long("y_per_meter", 1000, none, 0, 1000, none, none), long("colors_used", COLORS, none, 0, 0, none, none), long("colors_important", 5, none, 0, 5, none, none),
        long("red_mask", 0, 0, 255, 31744, 0, 0), long("green_mask", 0, 0, 65280, 992, 0, 0), long("blue_mask", 0, 0, 16711680, 31, 0, 0), "0::BIGINT AS alpha_mask", long("color_space", none, none, 1, none, none, none), "NULL::BIGINT AS intent",
        long("palette_start", 54, 26, 122, 54, 30, 30), long("palette_colors", COLORS, 16, 0, 0, 0, 0), f"{by(4, 3, 4, 4, 4, 4)}::INT AS palette_entry", long("data_start", 54 + 4 * COLORS, 74, 122, 54, 30, 30), long("row_bytes", 8, 4, 32, 16, 24, 24), "NULL::BIGINT AS profile_start", "NULL::BIGINT AS profile_size", "CASE WHEN v = 5 THEN 'short' END AS error",
    ]
    tga = [
        "3::BIGINT AS id_length", long("map_type", 1, 0, 0, 0), long("image_type", 1, 2, 3, 10), long("map_origin", FIRST, 0, 0, 0), long("map_length", COLORS, 0, 0, 0), long("map_depth", 24, 0, 0, 0), "0::BIGINT AS x_origin", "0::BIGINT AS y_origin", "8::BIGINT AS width", "8::BIGINT AS height", long("depth", 8, 16, 16, 32),
        long("alpha_bits", 0, 1, 8, 8), "v IN (1, 2) AS right_to_left", "v IN (0, 2) AS bottom_up", long("map_start", 21 + 3 * FIRST, none, none, none), long("data_start", 21 + 3 * COLORS, 21, 21, 21), long("row_bytes", 8, 16, 16, 32), "CASE WHEN v = 3 THEN 'compressed' END AS error",
    ]
    bits = lambda w, shift: f"({w} >> {shift} & 31)"
    eight = lambda w, shift: f"{bits(w, shift)} * 8 + {bits(w, shift)} // 4"
    w = "(g + 256 * (255 - g))"
    color = lambda k, known: [f"CASE WHEN {known} THEN {e} ELSE 0 END" for e in (k, f"255 - ({k})", f"({k}) * 7 % 256")]
    bmp_pixel = zip(color("g", f"g < {COLORS}"), ("g // 16 * 17", "g // 16 * 3", "255 - g // 16"), ("g", "255 - g", "g * 7 % 256"), [f"{bits(w, s)} * 8" for s in (10, 5, 0)], ("g * 7 % 256", "255 - g", "g"), strict=True)
    tga_pixel = zip(color(f"g + {FIRST}", f"g < {COLORS - FIRST}"), [eight(w, s) for s in (10, 5, 0)], ("g", "g", "g"), strict=True)
    return {
        "bmp_headers": f"SELECT vec_id AS image_id, {', '.join(bmp)} FROM (SELECT vec_id, vec_id % 6 AS v FROM embeddings)",
        "bmp_palettes": f"""SELECT vec_id AS image_id, i AS entry, (CASE v WHEN 0 THEN i ELSE i * 17 END)::INT AS r, (CASE v WHEN 0 THEN 255 - i ELSE i * 3 END)::INT AS g, (CASE v WHEN 0 THEN i * 7 % 256 ELSE 255 - i END)::INT AS b
          FROM (SELECT vec_id, vec_id % 6 AS v FROM embeddings), range({COLORS}) t(i) WHERE v = 0 OR v = 1 AND i < 16""",
        "bmp_pixels": f"WITH {emb} SELECT image_id, y, x, {', '.join(f'({by(*e)})::INT AS {n}' for n, e in zip(('r', 'g', 'b'), bmp_pixel, strict=True))}, 255 AS a FROM (SELECT *, image_id % 6 AS v FROM emb) WHERE v < 5",
        "tga_headers": f"SELECT vec_id AS image_id, {', '.join(tga)} FROM (SELECT vec_id, vec_id % 4 AS v FROM embeddings)",
        "tga_pixels": f"WITH {emb} SELECT image_id, y, x, {', '.join(f'({by(*e)})::INT AS {n}' for n, e in zip(('r', 'g', 'b'), tga_pixel, strict=True))}, CASE v WHEN 0 THEN 255 WHEN 1 THEN CASE WHEN {w} >= 32768 THEN 255 ELSE 0 END ELSE g * 3 % 256 END::INT AS a FROM (SELECT *, image_id % 4 AS v FROM emb) WHERE v < 3",
    }
