"""Regions of interest in JPEG 2000 sub-bands: which coefficients belong to rectangles, and the shift that sends these first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made
from rasterlake.operators.entropy import bit_size

#: How far the synthesis filters reach, low and high band, by wavelet; it is as far either way.
REACH = {"5/3": (1, 2), "9/7": (3, 4)}
#: Side of the cells in which coefficients meet rectangles.
CELL = 32
BAND = ["image_id", "frame_idx", "level", "band"]


def _half(v: Column) -> Column:
    return F.floor(v / 2)


def band_regions(rects: DataFrame, levels: int, wavelet: str = "5/3") -> DataFrame:
    """image_id, frame_idx, level, band, y0, x0, y1, x1 (the last row and column): where rectangles (image_id, frame_idx, width, height,
    x, y, w, h) act on the bands of decompose53.

    width and height are the image's; a rectangle is cut to it, and one that is empty or beyond it acts nowhere. A
    coefficient is in if the synthesis of any of the rectangle's samples uses it. Narrow: each rectangle is carried down
    the levels by itself. Bands may end before y1 or x1.
    """
    low, high = REACH[wavelet]
    inside = rects.where("w > 0 and h > 0 and x < width and y < height and x + w > 0 and y + h > 0")
    start = {f"{c}0": F.greatest(F.col(c), F.lit(0)).cast("long") for c in "xy"}
    stop = {f"{c}1": (F.least(F.col(c) + F.col(n), F.col(m)) - 1).cast("long") for c, n, m in (("x", "w", "width"), ("y", "h", "height"))}
    own = inside.select("image_id", "frame_idx", made(**start, **stop))
    out = None
    for level in range(1, levels + 1):
        side = lambda c: F.array(
            F.struct(F.lit("L").alias("b"), F.greatest(_half(F.col(f"{c}0") + 1 - low), F.lit(0)).alias("from"), _half(F.col(f"{c}1") + low).alias("to")),
            F.struct(F.lit("H").alias("b"), F.greatest(_half(F.col(f"{c}0") - high), F.lit(0)).alias("from"), _half(F.col(f"{c}1") - 1 + high).alias("to")),
        )
        each = own.select("image_id", "frame_idx", F.explode(side("x")).alias("i"), "y0", "y1").select("image_id", "frame_idx", "i", F.explode(side("y")).alias("j"))
        placed = each.select("image_id", "frame_idx", F.lit(level).alias("level"), F.concat("i.b", "j.b").alias("band"), F.col("j.from").alias("y0"), F.col("i.from").alias("x0"), F.col("j.to").alias("y1"), F.col("i.to").alias("x1"))
        kept = placed if level == levels else placed.where("band <> 'LL'")
        out = kept if out is None else out.unionByName(kept)
        own = placed.where("band = 'LL'").drop("level", "band")
    return out if out is not None else own.select("image_id", "frame_idx", F.lit(0).alias("level"), F.lit("LL").alias("band"), "y0", "x0", "y1", "x1")


def in_regions(bands: DataFrame, regions: DataFrame) -> DataFrame:
    """bands (image_id, frame_idx, level, band, y, x, ...) with roi: whether a region holds the place.

    Both sides are dealt into cells of CELL by CELL places, regions cut to each, so that they meet by an equi-join, and a
    coefficient meets each different piece of its cell, however many regions there are.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL)))
    cut = regions.withColumn("cy", cells("y0", "y1")).withColumn("cx", cells("x0", "x1"))
    piece = [F.greatest(F.col(f"{c}0"), F.col(f"c{c}") * CELL).alias(f"{c}0") for c in "yx"] + [F.least(F.col(f"{c}1"), F.col(f"c{c}") * CELL + CELL - 1).alias(f"{c}1") for c in "yx"]
    pieces = cut.groupBy(*BAND, "cy", "cx").agg(F.collect_set(F.struct(*piece)).alias("__pieces"))
    own = bands.withColumns({"cy": F.floor(F.col("y") / CELL), "cx": F.floor(F.col("x") / CELL)})
    met = own.join(pieces, [*BAND, "cy", "cx"], "left")
    held = F.exists("__pieces", lambda p: F.col("y").between(p["y0"], p["y1"]) & F.col("x").between(p["x0"], p["x1"]))
    return met.select(*bands.columns, F.coalesce(held, F.lit(False)).alias("roi"))


def scaled_up(bands: DataFrame, regions: DataFrame) -> DataFrame:
    """bands (image_id, frame_idx, level, band, y, x, v) with v shifted up where a region holds it, and shift, by how many bits.

    The shift of an image is the bits of its largest magnitude, so that each number of a region that is not 0 is above all
    others; an image of zeros has 0, as has one without coefficients. Numbers are cut towards zero by their magnitude.
    """
    shifts = bands.groupBy("image_id", "frame_idx").agg(F.max(bit_size(F.col("v"))).alias("shift"))
    known = in_regions(bands, regions).join(shifts, ["image_id", "frame_idx"])
    up = F.call_function("shiftleft", F.abs(F.col("v").cast("long")), F.col("shift")) * F.signum("v").cast("long")
    return known.withColumn("v", F.when(F.col("roi"), up).otherwise(F.col("v").cast("long"))).select(*bands.columns, "shift")


def scaled_down(bands: DataFrame) -> DataFrame:
    """The inverse of scaled_up, which needs no regions: what has more bits than the shift was shifted."""
    size = F.abs("v")
    down = F.call_function("shiftright", size, F.col("shift")) * F.signum("v").cast("long")
    return bands.withColumn("v", F.when(size >= F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift")), down).otherwise(F.col("v"))).drop("shift")
