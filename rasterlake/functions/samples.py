"""Samples of less than a byte, planes, checksums and quantisation tables, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.rgba import byte_at

#: Bit depths that a PNG may have, by its colour type.
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}

#: The standard's example tables for luminance and chrominance, by rows.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]


def png_is_legal(depth: Column, color_type: Column) -> Column:
    """Whether a PNG may have the bit depth with the colour type."""
    out = F.lit(False)
    for kind, depths in PNG_DEPTHS.items():
        out = out | ((color_type == kind) & depth.isin(*depths))
    return out


def packed_rows(samples: DataFrame, bits: int, width: Column | None = None) -> DataFrame:
    """Rows of bytes (image_id, frame_idx, y, content) of samples (image_id, frame_idx, y, x, v) of 1, 2 or 4 bits: the first one
    in the highest bits, places without a sample are zeros. A row has as many bytes as its width needs, and samples beyond it are left
    out; without a width it ends at its last sample. A group is one row of one image, and its bytes are summed first."""
    per = 8 // bits
    known = samples.withColumn("__w", F.lit(None).cast("int") if width is None else width.cast("int")).where("__w is null or x < __w")
    bytes_ = known.groupBy("image_id", "frame_idx", "y", F.floor(F.col("x") / per).cast("int").alias("k")).agg(F.sum(F.expr(f"shiftleft(cast(v as int), {8 - bits} - x % {per} * {bits})")).alias("byte"), F.max("__w").alias("__w"))
    rows = bytes_.groupBy("image_id", "frame_idx", "y").agg(F.map_from_entries(F.collect_list(F.struct("k", F.lpad(F.hex(F.col("byte").cast("long")), 2, "0")))).alias("m"), F.coalesce(F.floor((F.max("__w") - 1) / per), F.max("k")).cast("int").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("00")))
    return rows.select("image_id", "frame_idx", "y", F.unhex(F.array_join(dense, "")).alias("content"))


def unpacked_rows(rows: DataFrame, bits: int, width: Column) -> DataFrame:
    """Samples (image_id, frame_idx, y, x, v) of rows of bytes; a narrow operation."""
    per = 8 // bits
    each = rows.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))
    byte = byte_at(F.col("content"), F.floor(F.col("x") / per).cast("int"))
    value = F.floor(byte / F.pow(F.lit(2), 8 - bits - F.col("x") % per * bits)) % (1 << bits)
    return each.select("image_id", "frame_idx", "y", "x", value.cast("int").alias("v"))


def chunky(planes: Column, samples: Column, size: int = 1) -> Column:
    """Binary planes, one for each channel, as one binary of interleaved samples of `size` bytes; zeros where a plane is short."""
    one = lambda p, i: F.rpad(F.hex(F.substring(p, (i * size + 1).cast("int"), F.lit(size))), 2 * size, "0")
    pixel = lambda i: F.array_join(F.transform(planes, lambda p: one(p, i)), "")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), samples - 1), pixel), ""))


def adler32(content: Column) -> Column:
    """zlib's checksum; CRC-32 is Spark's own crc32."""
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def add(s: Column, i: Column) -> Column:
        a = (s["a"] + byte_at(content, i)) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    places = F.when(F.length(content) > 0, F.sequence(F.lit(0), F.length(content) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, add, lambda s: s["b"] * 65536 + s["a"])


def scaled_table(table: list[int], quality: Column) -> Column:
    """A quantisation table at a quality from 1 to 100."""
    factor = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    step = lambda q: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((q * factor + 50) / 100))).cast("int")
    return F.transform(F.array(*map(F.lit, table)), step)


def estimated_quality(luminance: Column, chrominance: Column | None = None) -> Column:
    """The quality that would scale the standard tables to about these: from the mean of the elements in percent of the
    standard ones; 100 for all ones. The lesser of the two, held within 0 and 100."""

    def one(own: Column, standard: list[int]) -> Column:
        percent = F.zip_with(own, F.array(*map(F.lit, standard)), lambda e, s: F.when(e == 0, F.lit(999.99)).otherwise(e * F.lit(100.0) / s))
        mean = F.aggregate(percent, F.lit(0.0), lambda t, p: t + p) / 64
        return F.when(F.forall(own, lambda e: e == 1), F.lit(100.0)).when(mean <= 100, (F.lit(200.0) - mean) / 2).otherwise(F.lit(5000.0) / mean)

    lesser = one(luminance, LUMINANCE) if chrominance is None else F.least(one(luminance, LUMINANCE), one(chrominance, CHROMINANCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), lesser))
