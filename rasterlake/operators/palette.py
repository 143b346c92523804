"""Statistics of images and palettes, as aggregates over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.color import gray

#: Distinct colours beyond which an image has no colour count.
MOST_COLORS = 256
MOST_ENTRIES = 65_536


def alpha_stats(pixels: DataFrame) -> DataFrame:
    """Per image: whether any pixel is not opaque, whether any is neither opaque nor clear, pixels, and mean alpha in thousandths."""
    return pixels.groupBy("image_id").agg(
        F.bool_or(F.col("a") != 255).alias("has_alpha"),
        F.bool_or(~F.col("a").isin(0, 255)).alias("soft_alpha"),
        F.count(F.lit(1)).alias("n_pixels"),
        F.floor(F.sum("a") * 1000 / F.count(F.lit(1))).cast("long").alias("mean_alpha_milli"),
    )


def color_counts(pixels: DataFrame) -> DataFrame:
    """Per image: the number of colours, null beyond 256, but for a 257th that only the last pixel has. Colours are counted
    once before they are counted per image."""
    place = F.struct("y", "x")
    colors = pixels.groupBy("image_id", "r", "g", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    n, at_end = F.count(F.lit(1)), F.max("first") == F.max("last")
    return colors.groupBy("image_id").agg(F.when((n <= MOST_COLORS) | ((n == MOST_COLORS + 1) & at_end), n).alias("n_colors"))


def icon_depth(pixels: DataFrame) -> DataFrame:
    """Per image: the least bits a pixel of an icon entry that hold it."""
    both = alpha_stats(pixels).join(color_counts(pixels), "image_id")
    depth = F.when(F.col("soft_alpha"), 32).when(F.col("n_colors").isNull() | (F.col("n_colors") > MOST_COLORS), 24).when(F.col("n_colors") <= 2, 1).when(F.col("n_colors") <= 16, 4).otherwise(8)
    return both.select("image_id", "n_colors", depth.alias("depth"))


def pnm_class(pixels: DataFrame) -> DataFrame:
    """Per image: 'pbm' if all pixels are black or white, 'pgm' if all are grey, else 'ppm'."""
    grey = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    out = pixels.groupBy("image_id").agg(F.bool_and(grey).alias("grey"), F.bool_and(grey & F.col("r").isin(0, 255)).alias("binary"))
    return out.select("image_id", F.when(F.col("binary"), "pbm").when(F.col("grey"), "pgm").otherwise("ppm").alias("pnm_class"))


def first_colors(pixels: DataFrame, most: int, padded: bool = False) -> DataFrame:
    """Per image: its first `most` colours in scan order, and black after them if padded. The window sees one row a colour, of
    which Spark keeps `most`."""
    colors = pixels.groupBy("image_id", "r", "g", "b").agg(F.min(F.struct("y", "x")).alias("scan"))
    ranked = colors.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("scan")) - 1)
    known = ranked.where(F.col("idx") < most).select("image_id", "idx", "r", "g", "b")
    if not padded:
        return known
    size = known.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") < most)
    black = [F.lit(0).alias(c) for c in "rgb"]
    return known.unionByName(size.select("image_id", F.explode(F.sequence("n", F.lit(most - 1))).alias("idx"), *black))


def apply_palette(indexes: DataFrame, palette: DataFrame) -> DataFrame:
    """indexes (..., idx) with r, g, b and a of the palette (idx, r, g, b, a, and image_id if each image has its own); null
    where the palette has no such entry. A palette for all images is broadcast: it has at most 65,536 entries."""
    if "image_id" in palette.columns:
        return indexes.join(palette, ["image_id", "idx"], "left")
    entries = palette.limit(MOST_ENTRIES + 1)
    if entries.count() > MOST_ENTRIES:
        raise ValueError("a palette has at most 65,536 entries")
    return indexes.join(F.broadcast(palette), "idx", "left")


def nearest_color(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """pixels with idx, the palette's nearest colour by squared distance, the first of equals. The palette is a constant of
    at most 256 colours, so this is one expression a pixel and no join."""
    if not 0 < len(palette) <= MOST_COLORS:
        raise ValueError("a palette has 1 to 256 colours")
    far = [F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(palette)]
    return pixels.withColumn("idx", (F.least(*far) if len(far) > 1 else far[0])["i"])


def histogram(pixels: DataFrame, bins: int = 16) -> DataFrame:
    """Pixels by grey value, over all images."""
    value = F.floor(gray(F.col("r"), F.col("g"), F.col("b")) * bins / 256).cast("int")
    return pixels.groupBy(value.alias("bin")).agg(F.count(F.lit(1)).alias("n_pixels"))


def channel_histogram(pixels: DataFrame) -> DataFrame:
    """Pixels by channel and value, over all images: the literal counts that prefix codes are built from."""
    each = pixels.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "rgba"])).alias("s"))
    return each.groupBy("s.channel", "s.value").agg(F.count(F.lit(1)).alias("n_pixels"))


def length_statistics(parts: DataFrame) -> DataFrame:
    """Of the parts or packets (image_id, tile, length) of tiles: per image how many there are, their bytes, the tiles up to
    the largest, and the least, largest and mean bytes (cut) and parts (rounded up) of a tile that has any."""
    tiles = parts.groupBy("image_id", "tile").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    return tiles.groupBy("image_id").agg(
        F.sum("n").alias("n_parts"), (F.max("tile") + 1).cast("long").alias("n_tiles"), F.sum("size").alias("total_size"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.floor(F.avg("size")).cast("long").alias("mean_size"),
        F.min("n").alias("min_parts"), F.max("n").alias("max_parts"), F.ceil(F.avg("n")).cast("long").alias("mean_parts"),
    )


def image_means(pixels: DataFrame) -> DataFrame:
    """Per image: size, sums of the channels, and extremes of grey."""
    g = gray(F.col("r"), F.col("g"), F.col("b"))
    sums = [F.sum(c).cast("long").alias(f"sum_{c}") for c in "rgba"]
    return pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), *sums, F.min(g).alias("min_gray"), F.max(g).alias("max_gray"))
