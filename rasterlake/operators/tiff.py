"""TIFF files as rows: directories, tags, images, strips and tiles, and the pixels of those that are not compressed.

files: any columns, and content. All of this is narrow: strips and tiles are cut from the file in its row, those of one place
in all planes together, and rows and pixels are exploded from them. Old and big files of either byte order are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.chunks import directories_of
from rasterlake.functions.color import rgb_of_cmyk, rgb_of_luma_ycbcr
from rasterlake.functions.rgba import byte_at, made

#: The tags' numbers, and the compressions that are none.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, COLOR_MAP, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT, LUMA, SUBSAMPLING = 317, 320, 322, 323, 324, 325, 338, 339, 529, 530
PLAIN = (0, 1)


def tiff_directories(files: DataFrame) -> DataFrame:
    """files with one row for each directory of their TIFF files: directory (from 0), start, tags, error ('cut', 'loop',
    'bad header', 'no directory'). Only the last one of a file may have an error; other files have no row."""
    each = files.select("*", F.posexplode(directories_of(F.col("content"))).alias("directory", "__d"))
    return each.select("*", "__d.*").drop("__d")


def tiff_entries(files: DataFrame) -> DataFrame:
    """files without content, with one row for each tag of their directories: directory, tag, type, count, value, values, error.

    value is the number in the entry: the tag's value if it is a single whole number that fits there, else where its values
    begin. values holds all numbers of a tag of whole numbers, and is null for other types. Values that would lie beyond the
    file are null and make the error 'beyond the file'; numbers of 2**63 and more are null. Tags of unknown types are left out.
    """
    other = [n for n in files.columns if n != "content"]
    return tiff_directories(files).select(*other, "directory", F.explode("tags").alias("__t")).select(*other, "directory", "__t.*")


def tiff_images(files: DataFrame) -> DataFrame:
    """files with one row for each directory: directory, width, height, bits, samples, photometric, compression, planar, and how
    it is stored: tiled, seg_width, seg_height, across, down (strips or tiles of a plane), planes, in_segment (samples of a
    pixel within one), row_bytes, offsets, counts, color_map, extra; error, null for an image whose pixels can be read.

    Errors are those of directories; 'no size'; 'no strips or tiles'; 'unsupported', for what is compressed, predicted, or of
    samples or colours that tiff_pixels does not take; 'short' where strips or tiles are too few, or have too few bytes or
    lie beyond the file; and 'no color map'. Of a tag that is there twice the last one counts.
    """
    other = [F.col(f"`{n}`") for n in files.columns]
    c = F.col
    all_of = lambda tag: F.try_element_at(F.filter("__t", lambda e: e["tag"] == tag), F.lit(-1))["values"]
    one = lambda tag, default=None: F.coalesce(F.get(all_of(tag), F.lit(0)), F.lit(default).cast("long"))
    t = tiff_directories(files).withColumnsRenamed({"tags": "__t", "error": "__error"})
    names = {"width": one(WIDTH), "height": one(HEIGHT), "bits": one(BITS, 1), "samples": one(SAMPLES, 1), "photometric": one(PHOTOMETRIC, 1), "compression": one(COMPRESSION, 1), "planar": one(PLANAR, 1)}
    names |= {"predictor": one(PREDICTOR, 1), "format": one(FORMAT, 1), "extra": one(EXTRA), "color_map": all_of(COLOR_MAP), "own_luma": F.exists("__t", lambda e: e["tag"] == LUMA), "sub": F.array_join(all_of(SUBSAMPLING).cast("array<string>"), ",")}
    names |= {"tile": all_of(TILE_OFFSETS), "tile_counts": all_of(TILE_COUNTS), "tile_width": one(TILE_WIDTH), "tile_height": one(TILE_HEIGHT), "strip": all_of(STRIP_OFFSETS), "strip_counts": all_of(STRIP_COUNTS), "strip_rows": F.nullif(one(STRIP_ROWS), F.lit(0).cast("long"))}
    t = t.select(*other, "directory", "__error", made(**names))
    tiled = c("tile").isNotNull()
    stored = {"tiled": tiled, "seg_width": F.when(tiled, c("tile_width")).otherwise(c("width")), "seg_height": F.when(tiled, c("tile_height")).otherwise(F.least(F.coalesce("strip_rows", "height"), "height"))}
    stored |= {"offsets": F.when(tiled, c("tile")).otherwise(c("strip")), "counts": F.when(tiled, c("tile_counts")).otherwise(c("strip_counts")), "planes": F.when((c("planar") == 2) & (c("samples") > 1), c("samples")).otherwise(F.lit(1).cast("long"))}
    keep = ["width", "height", "bits", "samples", "photometric", "compression", "planar", "predictor", "format", "extra", "color_map", "own_luma", "sub"]
    t = t.select(*other, "directory", "__error", *keep, made(**stored))
    per = lambda a, b: F.when(c(b) > 0, F.floor((c(a) + c(b) - 1) / c(b)))
    inner = F.when(c("planes") > 1, F.lit(1).cast("long")).otherwise(c("samples"))
    t = t.select("*", made(across=per("width", "seg_width"), down=per("height", "seg_height"), in_segment=inner, row_bytes=F.floor((c("seg_width").cast("double") * inner * c("bits") + 7) / 8).cast("long")))
    bits, samples, kind = c("bits"), c("samples"), c("photometric")
    whole = bits.isin(8, 16, 32)
    takes = (
        F.when(kind.isin(0, 1), whole | (bits == 64) | ((bits == 1) & (samples == 1)))
        .when(kind == 2, whole & (samples >= 3))
        .when(kind == 3, (bits == 8) | ((bits == 1) & (samples == 1)))
        .when(kind == 5, bits.isin(8, 16) & (samples >= 4))
        .when(kind == 6, (bits == 8) & (samples == 3) & ~c("own_luma") & (c("sub") == "1,1"))
    )
    takes &= (samples > 0) & c("compression").isin(*PLAIN) & c("planar").isin(1, 2) & (c("predictor") == 1) & (c("format") == 1)
    sure = lambda condition: F.coalesce(condition, F.lit(False))
    many = c("across").cast("double") * c("down") * c("planes")
    t = t.select("*", made(__takes=sure(takes), __sized=sure(F.least("width", "height") > 0), __cut=sure(F.least("seg_width", "seg_height") > 0) & c("offsets").isNotNull() & c("counts").isNotNull(), __enough=sure((many <= F.size("offsets")) & (many <= F.size("counts")))))
    index = F.when(c("__enough") & c("__sized") & c("__cut"), F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))

    def there(i: Column) -> Column:
        need = F.least(c("seg_height"), c("height") - F.floor(i / c("across")) % c("down") * c("seg_height")) * c("row_bytes")
        return sure((c("counts")[i.cast("int")] >= need) & (c("offsets")[i.cast("int")] + need <= F.length("content")))

    error = (
        F.when(c("__error").isNotNull(), c("__error"))
        .when(~c("__sized"), "no size")
        .when(~c("__cut"), "no strips or tiles")
        .when(~c("__takes"), "unsupported")
        .when(~c("__enough") | ~F.forall(index, there), "short")
        .when((kind == 3) & ~sure(F.size("color_map") >= F.when(bits == 8, 768).otherwise(6)), "no color map")
    )
    named = ["width", "height", "bits", "samples", "photometric", "compression", "planar", "tiled", "seg_width", "seg_height", "across", "down", "planes", "in_segment", "row_bytes", "offsets", "counts", "color_map", "extra"]
    return t.select(*other, "directory", *named, made(error=error))


def tiff_segments(files: DataFrame) -> DataFrame:
    """files without content, one row for each place of a strip or tile in the images that can be read: the columns of
    tiff_images but offsets and counts, segment (its number within a plane), y0 and x0 (its first pixel), rows and cols (the
    pixels of it that lie within the image), and parts, an array of its bytes in each plane."""
    t = tiff_images(files).where("error is null").drop("error")
    n = F.col("across") * F.col("down")
    t = t.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    t = t.select("*", made(y0=F.floor(F.col("segment") / F.col("across")) * F.col("seg_height"), x0=F.col("segment") % F.col("across") * F.col("seg_width")))
    t = t.select("*", made(rows=F.least(F.col("seg_height"), F.col("height") - F.col("y0")), cols=F.least(F.col("seg_width"), F.col("width") - F.col("x0"))))
    at = lambda p: (F.col("offsets")[(p * n + F.col("segment")).cast("int")] + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("planes") - 1), lambda p: F.substring("content", at(p), (F.col("rows") * F.col("row_bytes")).cast("int")))
    return t.select("*", made(parts=parts)).drop("content", "offsets", "counts")


def tiff_pixels(files: DataFrame) -> DataFrame:
    """files without content, with the pixels of their images: directory, y, x, r, g, b, a.

    Samples of several bytes count by their last one in either byte order, as other readers of these files take them. Grey has
    alpha if its first extra sample is one, RGB from four samples on, and CMYK from five.
    """
    other = [n for n in files.columns if n != "content"]
    s = tiff_segments(files)
    s = s.withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    bits, kind = F.col("bits"), F.col("photometric")
    step = F.floor(bits / 8)

    def sample(k: int) -> Column:
        inner = F.when(F.col("planes") > 1, F.lit(0)).otherwise(F.lit(k))
        at = F.col("__r") * F.col("row_bytes") + (F.col("__i") * F.col("in_segment") + inner) * step + step - 1
        return byte_at(F.get(F.col("parts"), F.when(F.col("planes") > 1, F.lit(k)).otherwise(F.lit(0))), at.cast("int"))

    byte = byte_at(F.col("parts")[0], (F.col("__r") * F.col("row_bytes") + F.floor(F.col("__i") / 8)).cast("int"))
    single = F.floor(byte / F.pow(F.lit(2), 7 - F.col("__i") % 8)).cast("long") % 2
    s0, s1, s2, s3, s4 = (F.col(f"__s{k}") for k in range(5))
    s = s.select("*", made(__s0=F.when(bits == 1, single).otherwise(sample(0)), **{f"__s{k}": F.when(F.col("samples") > k, sample(k)) for k in range(1, 5)}))
    gray = F.when(bits == 1, s0 * 255).otherwise(s0)
    gray = F.when(kind == 0, 255 - gray).otherwise(gray)
    size = F.when(bits == 8, 256).otherwise(2)
    mapped = lambda k: F.shiftright(F.get(F.col("color_map"), (s0 + k * size).cast("int")), 8)
    inks, luma = rgb_of_cmyk(s0, s1, s2, s3), rgb_of_luma_ycbcr(s0, s1, s2)
    color = [F.when(kind.isin(0, 1), gray).when(kind == 2, (s0, s1, s2)[k]).when(kind == 3, mapped(k)).when(kind == 5, inks[k]).otherwise(luma[k]).cast("int").alias(n) for k, n in enumerate("rgb")]
    alpha = F.when(kind.isin(0, 1), F.when(F.col("extra").isin(1, 2), s1)).when(kind == 2, s3).when(kind == 5, s4)
    place = [(F.col("y0") + F.col("__r")).cast("int").alias("y"), (F.col("x0") + F.col("__i")).cast("int").alias("x")]
    return s.select(*other, "directory", *place, *color, F.coalesce(alpha, F.lit(255)).cast("int").alias("a"))
