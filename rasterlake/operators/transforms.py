"""Reversible transforms of samples: colour, wavelet, and the orders in which formats send pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rasterlake.functions.color import rgb_of_studio_yuv, studio_yuv


def reversible_color(r: Column, g: Column, b: Column) -> list[Column]:
    """JPEG 2000's reversible colour transform."""
    return [F.floor((r + 2 * g + b) / 4).cast("int").alias("y"), (b - g).cast("int").alias("u"), (r - g).cast("int").alias("v")]


def color_of_reversible(y: Column, u: Column, v: Column) -> list[Column]:
    g = y - F.floor((u + v) / 4)
    return [(v + g).cast("int").alias("r"), g.cast("int").alias("g"), (u + g).cast("int").alias("b")]


def adam7_pass(x: Column, y: Column) -> Column:
    """The interlace pass, from 1 to 7, that sends a pixel."""
    x8, y8 = x % 8, y % 8
    return (
        F.when((x8 == 0) & (y8 == 0), 1)
        .when((x8 == 4) & (y8 == 0), 2)
        .when((x8 % 4 == 0) & (y8 == 4), 3)
        .when((x8 % 4 == 2) & (y8 % 4 == 0), 4)
        .when((x8 % 2 == 0) & (y8 % 4 == 2), 5)
        .when((x8 % 2 == 1) & (y8 % 2 == 0), 6)
        .otherwise(7)
    )


def gif_pass(y: Column) -> Column:
    """The interlace pass, from 1 to 4, that sends a row."""
    return F.when(y % 8 == 0, 1).when(y % 8 == 4, 2).when(y % 4 == 2, 3).otherwise(4)


def zigzag(x: Column, y: Column) -> Column:
    """Place of a coefficient of an 8 x 8 block in zig-zag order."""
    d = x + y
    before = F.when(d < 8, F.floor(d * (d + 1) / 2)).otherwise(64 - F.floor((15 - d) * (16 - d) / 2))
    step = F.when(d % 2 == 0, x).otherwise(y) - F.when(d < 8, 0).otherwise(d - 7)
    return (before + step).cast("int")


def scaled_quantum(q: Column, quality: int) -> Column:
    """A quantisation step at a quality from 1 to 100: 50 leaves it, lower qualities raise it."""
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return F.greatest(F.lit(1), F.least(F.lit(255), F.floor((q * factor + 50) / 100))).cast("int")


def lifting_row(along: str = "x") -> WindowSpec:
    """One row of one image, or one column."""
    other = {"x": "y", "y": "x"}[along]
    return Window.partitionBy("image_id", "frame_idx", other).orderBy(along)


def wavelet53(pixels: DataFrame, value: str, out: str = "coefficient", along: str = "x") -> DataFrame:
    """One level of the reversible 5/3 wavelet along rows (or columns): even places get the low band, odd ones the high band.
    Rows are mirrored at their ends; a row of one pixel stays as it is. Windows are over one row."""
    row = lifting_row(along)
    odd = F.col(along) % 2 == 1
    before, after = F.lag(value).over(row), F.lead(value).over(row)
    high = pixels.withColumn("__h", F.when(odd, F.col(value) - F.floor((before + F.coalesce(after, before)) / 2)))
    left, right = F.lag("__h").over(row), F.lead("__h").over(row)
    both = F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0))
    low = F.when(left.isNull() & right.isNull(), F.col(value)).otherwise(F.col(value) + F.floor((both + 2) / 4))
    return high.withColumn(out, F.when(odd, F.col("__h")).otherwise(low).cast("int")).drop("__h")


def inverse_wavelet53(coefficients: DataFrame, value: str, out: str, along: str = "x") -> DataFrame:
    """The samples that wavelet53 made `value` of."""
    row = lifting_row(along)
    odd = F.col(along) % 2 == 1
    left, right = F.lag(value).over(row), F.lead(value).over(row)
    both = F.coalesce(left, right, F.lit(0)) + F.coalesce(right, left, F.lit(0))
    even = coefficients.withColumn("__e", F.when(~odd, F.when(left.isNull() & right.isNull(), F.col(value)).otherwise(F.col(value) - F.floor((both + 2) / 4))))
    before, after = F.lag("__e").over(row), F.lead("__e").over(row)
    return even.withColumn(out, F.when(odd, F.col(value) + F.floor((before + F.coalesce(after, before)) / 2)).otherwise(F.col("__e")).cast("int")).drop("__e")


#: The steps and the two gains of the 9/7 wavelet.
STEPS97 = (-1.586134342, -0.05298011854, 0.8829110762, 0.4435068522)
LOW97, HIGH97 = 0.8128930655, 1.230174106


def wavelet97(pixels: DataFrame, value: str, out: str = "coefficient", along: str = "x") -> DataFrame:
    """One level of the 9/7 wavelet in single precision: four lifting steps, of odd places and even ones in turn, each by the
    sum of its neighbours (twice the one there is at an end), and gains. A row of one pixel stays as it is."""
    row = lifting_row(along)
    odd = F.col(along) % 2 == 1
    single = lambda v: F.lit(v).cast("float")
    lifted = pixels.withColumns({"__v": F.col(value).cast("float"), "__n": F.count(F.lit(1)).over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    for k, step in enumerate(STEPS97):
        before, after = F.lag("__v").over(row), F.lead("__v").over(row)
        both = F.coalesce(before, after) + F.coalesce(after, before)
        moved = odd if k % 2 == 0 else ~odd
        lifted = lifted.withColumn("__v", F.when(moved & (F.col("__n") > 1), F.col("__v") + single(step) * both).otherwise(F.col("__v")))
    gain = F.when(F.col("__n") == 1, single(1.0)).when(odd, single(HIGH97)).otherwise(single(LOW97))
    return lifted.withColumn(out, F.col("__v") * gain).drop("__v", "__n")


def inverse_wavelet97(coefficients: DataFrame, value: str, out: str, along: str = "x") -> DataFrame:
    """The samples that wavelet97 made `value` of, but for rounding in single precision: its steps backwards."""
    row = lifting_row(along)
    odd = F.col(along) % 2 == 1
    single = lambda v: F.lit(v).cast("float")
    n = F.count(F.lit(1)).over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lifted = coefficients.withColumn("__n", n)
    gain = F.when(F.col("__n") == 1, single(1.0)).when(odd, single(HIGH97)).otherwise(single(LOW97))
    lifted = lifted.withColumn("__v", (F.col(value).cast("float") / gain).cast("float"))
    for k, step in reversed([*enumerate(STEPS97)]):
        before, after = F.lag("__v").over(row), F.lead("__v").over(row)
        both = F.coalesce(before, after) + F.coalesce(after, before)
        moved = odd if k % 2 == 0 else ~odd
        lifted = lifted.withColumn("__v", F.when(moved & (F.col("__n") > 1), F.col("__v") - single(step) * both).otherwise(F.col("__v")))
    return lifted.withColumn(out, F.col("__v")).drop("__v", "__n")


def decompose53(pixels: DataFrame, value: str, levels: int) -> DataFrame:
    """Several levels of the 5/3 wavelet in two dimensions, columns before rows: image_id, frame_idx, level, band ('LL', 'HL',
    'LH', 'HH'; 'LL' only of the last level), y, x, v. Each level works on a quarter of the one before."""
    low, out = pixels.select("image_id", "frame_idx", "y", "x", F.col(value).cast("int").alias("v")), None
    for level in range(1, levels + 1):
        both = wavelet53(wavelet53(low, "v", "v", "y"), "v", "v", "x")
        band = F.concat(F.when(F.col("x") % 2 == 1, "H").otherwise("L"), F.when(F.col("y") % 2 == 1, "H").otherwise("L"))
        half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("y", "x")]
        placed = both.select("image_id", "frame_idx", F.lit(level).alias("level"), band.alias("band"), *half, "v")
        details = placed.where("band <> 'LL'")
        out = details if out is None else out.unionByName(details)
        low = placed.where("band = 'LL'").drop("level", "band")
    return out.unionByName(low.select("image_id", "frame_idx", F.lit(levels).alias("level"), F.lit("LL").alias("band"), "y", "x", "v"))


def compose53(bands: DataFrame, levels: int) -> DataFrame:
    """The samples (image_id, frame_idx, y, x, v) of decompose53's bands."""
    key = ["image_id", "frame_idx", "y", "x", "v"]
    low = bands.where("band = 'LL'").select(*key)
    for level in range(levels, 0, -1):
        each = low.withColumn("band", F.lit("LL")).unionByName(bands.where((F.col("level") == level) & (F.col("band") != "LL")).select(*key, "band"))
        place = lambda c, k: (F.col(c) * 2 + (F.substring("band", k, 1) == "H").cast("int")).alias(c)
        wide = each.select("image_id", "frame_idx", place("y", 2), place("x", 1), "v")
        low = inverse_wavelet53(inverse_wavelet53(wide, "v", "v", "x"), "v", "v", "y").select(*key)
    return low


#: Rows of JPEG 2000's irreversible colour transform, and the factors of its inverse.
FORWARD = ((0.299, 0.587, 0.114), (-0.16875, -0.33126, 0.5), (0.5, -0.41869, -0.08131))
RED_V, GREEN_U, GREEN_V, BLUE_U = 1.402, 0.34413, 0.71414, 1.772


def irreversible_color(r: Column, g: Column, b: Column) -> list[Column]:
    """JPEG 2000's irreversible colour transform in single precision."""
    k = lambda v: F.lit(v).cast("float")
    r, g, b = (c.cast("float") for c in (r, g, b))
    return [(k(x) * r + k(y) * g + k(z) * b).alias(n) for n, (x, y, z) in zip("yuv", FORWARD, strict=True)]


def color_of_irreversible(y: Column, u: Column, v: Column) -> list[Column]:
    """Its inverse; a half is added and the rest cut."""
    k = lambda x: F.lit(x).cast("float")
    half = k(0.5)
    return [(y + k(RED_V) * v + half).cast("int").alias("r"), (y - k(GREEN_U) * u - k(GREEN_V) * v + half).cast("int").alias("g"), (y + k(BLUE_U) * u + half).cast("int").alias("b")]


def dead_zone(c: Column, step: Column | float) -> Column:
    """The index of a coefficient's interval: its size over the step, cut, with its sign."""
    size = F.floor(F.abs(c) / step)
    return F.when(c < 0, -size).otherwise(size).cast("int")


def of_dead_zone(q: Column, step: Column | float, inside: float = 0.5) -> Column:
    """A coefficient of an index: at a share `inside` of its interval; 0 for the dead zone."""
    return F.when(q > 0, (q + F.lit(inside)) * step).when(q < 0, (q - F.lit(inside)) * step).otherwise(F.lit(0.0))


def dequantized(c: Column, quantum: Column) -> Column:
    return c * quantum


def level_shifted(v: Column, bits: int = 8) -> Column:
    """A sample about 0 as one from 0 on: rounded half to even, then raised by half of the range, held within it."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.rint(v) + (1 << bits - 1))).cast("int")


def tile_grid(images: DataFrame, tile_width: Column, tile_height: Column) -> DataFrame:
    """images (..., width, height) with one row for each tile: tile (in rows), tx, ty, x, y, w and h, which are smaller at the
    right and lower ends."""
    many = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    each = images.withColumns({"__tw": tile_width.cast("int"), "__th": tile_height.cast("int")})
    each = each.withColumn("ty", F.explode(F.sequence(F.lit(0), many("height", F.col("__th")) - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), many("width", F.col("__tw")) - 1)))
    each = each.withColumns({"tile": F.col("ty") * many("width", F.col("__tw")) + F.col("tx"), "x": F.col("tx") * F.col("__tw"), "y": F.col("ty") * F.col("__th")})
    return each.withColumns({"w": F.least("__tw", F.col("width") - F.col("x")), "h": F.least("__th", F.col("height") - F.col("y"))}).drop("__tw", "__th")


def chroma_420(pixels: DataFrame) -> DataFrame:
    """The chroma samples of 2 x 2 pixels, taken from the one above to the left: image_id, frame_idx, cy, cx, u, v."""
    _, u, v = studio_yuv(*map(F.col, "rgb"))
    half = [F.floor(F.col(c) / 2).cast("int").alias(f"c{c}") for c in ("y", "x")]
    return pixels.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select("image_id", "frame_idx", *half, u, v)


def rgb_of_420(luma: DataFrame, chroma: DataFrame, fancy: bool = True) -> DataFrame:
    """Pixels of luma (image_id, frame_idx, y, x, l) and chroma (..., cy, cx, u, v). Simple: a pixel's own sample. Fancy: nine
    parts of it, three of its neighbour on either axis and one of that on both, rounded; at an end its own for what is missing
    (so too in the last column of an even width). Joins are on samples' places, and a pixel has at most four."""
    place = ["image_id", "frame_idx", "cy", "cx"]
    own = {f"c{c}": F.floor(F.col(c) / 2).cast("int") for c in ("y", "x")}
    key = ["image_id", "frame_idx", "y", "x", "l"]
    if not fancy:
        mixed = luma.withColumns(own).join(chroma, place)
    else:
        size = chroma.groupBy("image_id", "frame_idx").agg(F.max("cy").alias("ey"), F.max("cx").alias("ex"))
        near = luma.join(size, ["image_id", "frame_idx"]).withColumns(own)
        other = lambda c: F.greatest(F.lit(0), F.least(F.col(f"e{c}"), F.col(f"c{c}") + F.when(F.col(c) % 2 == 1, 1).otherwise(-1)))
        part = lambda cy, cx, n: F.struct(cy.alias("cy"), cx.alias("cx"), F.lit(n).alias("n"))
        cy, cx, oy, ox = F.col("cy"), F.col("cx"), other("y"), other("x")
        parts = near.select(*key, F.inline(F.array(part(cy, cx, 9), part(cy, ox, 3), part(oy, cx, 3), part(oy, ox, 1)))).join(chroma, place)
        total = lambda c: F.floor((F.sum(F.col(c) * F.col("n")) + 8) / 16).cast("int").alias(c)
        mixed = parts.groupBy(*key).agg(total("u"), total("v"))
    return mixed.select("image_id", "frame_idx", "y", "x", *rgb_of_studio_yuv(F.col("l"), F.col("u"), F.col("v")), F.lit(255).alias("a"))
