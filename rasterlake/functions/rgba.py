"""Bytes and pixels of RGBA buffers (row-major, four bytes a pixel) as columns.

Spark's bytes are signed and binary has no index operator, so a byte is read as two hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def made(**columns: Column) -> Column:
    """Columns that are computed once a row, and not again wherever what follows names them."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def unsigned(b: Column) -> Column:
    """A short big-endian binary as a number."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def byte_at(b: Column, i) -> Column:
    return unsigned(F.substring(b, i + 1 if isinstance(i, int) else i + F.lit(1), F.lit(1)))


def pixel_word(rgba: Column, k: Column) -> Column:
    """The k-th pixel as 0xRRGGBBAA."""
    return unsigned(F.substring(rgba, (k * 4 + 1).cast("int"), F.lit(4)))


def pack(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """0xRRGGBBAA; alpha is 255 unless given."""
    alpha = F.lit(255) if a is None else a
    return ((r.cast("long") * 256 + g) * 256 + b) * 256 + alpha


def unpack(word: Column) -> list[Column]:
    """r, g, b, a of 0xRRGGBBAA."""
    return [F.shiftright(word, s).bitwiseAND(255).cast("int").alias(n) for n, s in zip("rgba", (24, 16, 8, 0), strict=True)]


def word_bytes(word: Column) -> Column:
    """0xRRGGBBAA as four bytes."""
    return F.unhex(F.lpad(F.hex(word), 8, "0"))


def inside(width: Column, height: Column, x: Column, y: Column) -> Column:
    """(y * width + x), or an error for a pixel out of bounds."""
    ok = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.when(ok, y * width + x).otherwise(F.raise_error(F.lit("pixel out of bounds")).cast("long"))


def get_pixel(rgba: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    return pixel_word(rgba, inside(width, height, x, y))


def set_pixel(rgba: Column, width: Column, height: Column, x: Column, y: Column, word: Column) -> Column:
    return F.overlay(rgba, word_bytes(word), (inside(width, height, x, y) * 4 + 1).cast("int"), F.lit(4))


def row_bytes(rgba: Column, width: Column, y: Column) -> Column:
    """One row of pixels."""
    return F.substring(rgba, (y * width * 4 + 1).cast("int"), (width * 4).cast("int"))


def blank(width: Column, height: Column) -> Column:
    """Transparent black pixels; a size that is not positive is an error."""
    n = F.when((width > 0) & (height > 0), width * height).otherwise(F.raise_error(F.lit("width and height must be positive")).cast("int"))
    return F.unhex(F.repeat(F.lit("00000000"), n.cast("int")))


def clamp_byte(v: Column) -> Column:
    """0 below 0, 255 above 255, else rounded half up."""
    return F.when(v < 0, 0).when(v > 255, 255).otherwise(F.floor(v + F.lit(0.5)).cast("int")).cast("int")
