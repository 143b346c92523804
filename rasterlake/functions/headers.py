"""What a file's header says, read as columns: no file is decoded for it, and only its first bytes are touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.chunks import chunks_of
from rasterlake.functions.formats import format_of_bytes
from rasterlake.functions.rgba import unsigned


#: Fixed value: the blocks of the GIF extension that holds the loop count, in hexadecimal digits up to it.
NETSCAPE = "0B4E45545343415045322E300301"


def big(b: Column, at: int | Column, size: int) -> Column:
    """An unsigned big-endian number of `size` bytes at a place counted from 0."""
    return unsigned(F.substring(b, (F.lit(at) + 1).cast("int") if isinstance(at, int) else (at + 1).cast("int"), F.lit(size)))


def little(b: Column, at: int | Column, size: int) -> Column:
    place = F.lit(at) if isinstance(at, int) else at
    out = big(b, place, 1)
    for k in range(1, size):
        out = out + big(b, place + k, 1) * (1 << 8 * k)
    return out


def signed32(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def header(content: Column, kind: Column | None = None) -> Column:
    """struct<format, width, height, depth>: depth is bits a pixel, or a sample for PNG; nulls for what a format's header
    does not hold at a fixed place, or for a format that is not known. TGA has no signature, so its kind must be given."""
    f = format_of_bytes(content) if kind is None else kind
    core = bmp_core(content)
    of = lambda **by: _choose(f, by)
    icon = lambda v: F.when(v == 0, 256).otherwise(v)
    return F.struct(
        f.alias("format"),
        of(png=big(content, 16, 4), gif=little(content, 6, 2), bmp=F.when(core, little(content, 18, 2)).otherwise(little(content, 18, 4)), qoi=big(content, 4, 4), tga=little(content, 12, 2), webp=_vp8x(content, 24), ico=icon(big(content, 6, 1)), cur=icon(big(content, 6, 1))).alias("width"),
        of(png=big(content, 20, 4), gif=little(content, 8, 2), bmp=F.when(core, little(content, 20, 2)).otherwise(F.abs(signed32(little(content, 22, 4)))), qoi=big(content, 8, 4), tga=little(content, 14, 2), webp=_vp8x(content, 27), ico=icon(big(content, 7, 1)), cur=icon(big(content, 7, 1))).alias("height"),
        of(png=big(content, 24, 1), gif=big(content, 10, 1) % 8 + 1, bmp=F.when(core, little(content, 24, 2)).otherwise(little(content, 28, 2)), qoi=big(content, 12, 1) * 8, tga=big(content, 16, 1), ico=little(content, 12, 2)).alias("depth"),
    )


def bmp_core(content: Column) -> Column:
    """Whether a BMP has the old header of 12 bytes, with sides of two bytes."""
    return little(content, 14, 4) == 12


def pnm_header(content: Column) -> Column:
    """struct<format, width, height, most> of a Netpbm file: its numbers, without the comments between them; the largest sample
    is 1 for bitmaps. Headers are looked for in the first 1,000 bytes."""
    text = F.regexp_replace(F.decode(F.substring(content, 1, 1000), "ISO-8859-1"), r"#[^\n\r]*", "")
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(P[1-6])\s+(\d+)\s+(\d+)(?:\s+(\d+))?\s", k), F.lit(""))
    kind = F.translate(part(1), "P", "").cast("int")
    most = F.when(kind.isin(1, 4), F.lit(1)).otherwise(part(4).cast("int"))
    name = F.when(kind.isin(1, 4), "pbm").when(kind.isin(2, 5), "pgm").when(kind.isin(3, 6), "ppm")
    return F.struct(name.alias("format"), part(2).cast("long").alias("width"), part(3).cast("long").alias("height"), most.alias("most"))


def loop_count(content: Column) -> Column:
    """How often an animated GIF or WebP is to be shown, 0 for ever: from the first block that says so; null if there is none."""
    head = lambda c: F.hex(F.substring(content, (c["start"] + 1).cast("int"), F.lit(14)))
    says = lambda c: c["error"].isNull() & ((c["kind"] == "ANIM") & (c["size"] >= 6) | (c["kind"] == "ext/FF") & (head(c) == NETSCAPE))
    first = F.get(F.filter(chunks_of(content), says), F.lit(0))
    return little(content, first["start"] + F.when(first["kind"] == "ANIM", 4).otherwise(14), 2)


def _choose(f: Column, by: dict[str, Column]) -> Column:
    out = F.lit(None).cast("long")
    for name, value in by.items():
        out = F.when(f == name, value.cast("long")).otherwise(out)
    return out


def _vp8x(content: Column, at: int) -> Column:
    """A side of an extended WebP file."""
    return F.when(F.hex(F.substring(content, 13, 4)) == "56503858", little(content, at, 3) + 1)


def icon_entries(files: DataFrame) -> DataFrame:
    """One row for each entry of icons and cursors in files (…, content): entry, width, height, colors, x and y of the
    hotspot (planes and depth in an icon), size and offset of its image."""
    many = F.when(format_of_bytes(F.col("content")).isin("ico", "cur"), little(F.col("content"), 4, 2)).otherwise(0)
    each = files.withColumn("entry", F.explode(F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("entry") * 16 + 6
    side = lambda k: F.when(big(F.col("content"), at + k, 1) == 0, 256).otherwise(big(F.col("content"), at + k, 1))
    word = lambda k, n: little(F.col("content"), at + k, n)
    return each.withColumns({"width": side(0), "height": side(1), "colors": word(2, 1), "x": word(4, 2), "y": word(6, 2), "size": word(8, 4), "offset": word(12, 4)})
