"""Colour conversions as column expressions; all stay in the JVM's generated code.

The factors are those of the formats' standards: BT.601 luma, full-range JPEG YCbCr, BT.601 studio YUV, sRGB's curve.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.functions.rgba import clamp_byte


#: WebP's whole-number factors and offsets from studio YUV to red, green and blue, in 1/16,384 and 1/64.
STUDIO_LUMA, STUDIO_CHROMA, STUDIO_OFFSETS = 19077, (26149, (6419, 13320), 33050), (-14234, 8708, -17685)


def whole(c: Column) -> Column:
    """Cut towards zero."""
    return c.cast("int")


def div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Netpbm's luma in thousandths, rounded half up."""
    return div(r * 299 + g * 587 + b * 114 + 500, 1000)


def bit(luma: Column) -> Column:
    """1 (black) below 128."""
    return (luma < 128).cast("int")


def scale_sample(v: Column, most: Column) -> Column:
    """A sample of 0..most as 0..255, rounded half up."""
    return F.floor((v * 255 + F.floor(most / 2)) / most).cast("int")


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """JPEG's YCbCr, cut towards zero."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b
    cr = 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    return [whole(clamped(c)).alias(n) for n, c in (("y", y), ("cb", cb), ("cr", cr))]


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def rgb_of_ycbcr(y: Column, cb: Column, cr: Column) -> list[Column]:
    """RGB of JPEG's YCbCr; each term is cut towards zero by itself."""
    u, v = cb - 128, cr - 128
    r = y + whole(1.402 * v)
    g = y - whole(0.344136 * u) - whole(0.714136 * v)
    b = y + whole(1.772 * u)
    return [clamped(c).cast("int").alias(n) for n, c in (("r", r), ("g", g), ("b", b))]


def rgb_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """(255 - ink) * (255 - black) / 255, cut towards zero."""
    return [div((255 - ink) * (255 - k), 255).alias(n) for n, ink in (("r", c), ("g", m), ("b", y))]


def studio_yuv(r: Column, g: Column, b: Column) -> list[Column]:
    """BT.601 studio-range YUV in 1/256, rounded half up."""
    y = F.shiftright(66 * r + 129 * g + 25 * b + 128, 8) + 16
    u = F.shiftright(-38 * r - 74 * g + 112 * b + 128, 8) + 128
    v = F.shiftright(112 * r - 94 * g - 18 * b + 128, 8) + 128
    return [clamped(c).cast("int").alias(n) for n, c in (("y", y), ("u", u), ("v", v))]


def linear_of_srgb(v: Column) -> Column:
    """Linear light of an sRGB value, both from 0 to 1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def srgb_of_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def fixed_of_double(v: Column) -> Column:
    """Signed 2.13 fixed point as an unsigned 16-bit number: held within -4 and 3.99987793, rounded half to even."""
    held = F.greatest(F.lit(-4.0), F.least(F.lit(3.99987793), v))
    return F.rint(held * 8192).cast("int").bitwiseAND(0xFFFF)


def double_of_fixed(v: Column) -> Column:
    return F.when(v >= 32768, v - 65536).otherwise(v) / F.lit(8192.0)


def rgba_of_fixed(r: Column, g: Column, b: Column, a: Column, curve: bool = True) -> list[Column]:
    """Bytes of four s2.13 numbers; colours, not alpha, go through the sRGB curve if curve is set."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), double_of_fixed(v)))
    byte = lambda v: F.floor(v * 255 + F.lit(0.5)).cast("int")
    return [byte(srgb_of_linear(unit(c)) if curve and n != "a" else unit(c)).alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)]


def fixed_of_rgba(r: Column, g: Column, b: Column, a: Column, curve: bool = True) -> list[Column]:
    """Four s2.13 numbers of a pixel; colours become linear light if curve is set."""
    unit = lambda v: v / F.lit(255.0)
    return [fixed_of_double(linear_of_srgb(unit(c)) if curve and n != "a" else unit(c)).alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)]


def masked(word: Column, mask: int) -> Column:
    """The channel that a mask of a word's bits takes, scaled by 256 >> bits (five bits: 31 becomes 248) if it has fewer than
    eight; more than 255 is 255, and so is a channel without a mask."""
    if mask == 0:
        return F.lit(255)
    shift = (mask & -mask).bit_length() - 1
    bits = (mask >> shift).bit_count()
    value = F.shiftright(word.cast("long").bitwiseAND(F.lit(mask).cast("long")), shift) * (256 >> bits if bits < 8 else 1)
    return F.least(value, F.lit(255)).cast("int")


def white_is_zero(v: Column) -> Column:
    """A sample of a picture in which 0 is white."""
    return 255 - v


def five_to_eight(v: Column) -> Column:
    """Five bits as eight, the high bits repeated below."""
    return v * 8 + F.shiftright(v, 2)


def word_555(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r, 3) * 1024 + F.shiftright(g, 3) * 32 + F.shiftright(b, 3)


def gray_of_16(v: Column) -> Column:
    """A 16-bit grey as 8 bits, rounded half to even."""
    return F.rint(v * 255 / F.lit(65535)).cast("int")


def high_byte(v: Column) -> Column:
    """A 16-bit colour sample as 8 bits."""
    return F.shiftright(v, 8)


def rgb_of_luma_ycbcr(y: Column, cb: Column, cr: Column, luma: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> list[Column]:
    """RGB of TIFF's YCbCr with its own luma coefficients, in single precision, held within bytes and cut."""
    lr, lg, lb = map(np.float32, luma)
    one, two = np.float32(1), np.float32(2)
    k = lambda v: F.lit(float(v)).cast("float")
    yf, u, v = y.cast("float"), cb.cast("float") - k(128), cr.cast("float") - k(128)
    r = yf + k(two * (one - lr)) * v
    g = yf + k(-two * lr * (one - lr) / lg) * v + k(-two * lb * (one - lb) / lg) * u
    b = yf + k(two * (one - lb)) * u
    return [F.greatest(k(0), F.least(k(255), c)).cast("int").alias(n) for n, c in (("r", r), ("g", g), ("b", b))]


def rgb_of_studio_yuv(y: Column, u: Column, v: Column) -> list[Column]:
    """RGB of BT.601 studio-range YUV as WebP takes it."""
    part = lambda c, by: F.shiftright(c * by, 8)
    clip = lambda c: clamped(F.shiftright(c, 6)).cast("int")
    luma = part(y, STUDIO_LUMA)
    red, (green_u, green_v), blue = STUDIO_CHROMA
    low_red, low_green, low_blue = STUDIO_OFFSETS
    return [clip(luma + part(v, red) + low_red).alias("r"), clip(luma - part(u, green_u) - part(v, green_v) + low_green).alias("g"), clip(luma + part(u, blue) + low_blue).alias("b")]


def luma_bytes(r: Column, g: Column, b: Column) -> Column:
    return clamp_byte(0.299 * r + 0.587 * g + 0.114 * b)


def subtract_green(r: Column, g: Column, b: Column) -> list[Column]:
    return [F.pmod(r - g, F.lit(256)).alias("r"), g.alias("g"), F.pmod(b - g, F.lit(256)).alias("b")]


def add_green(r: Column, g: Column, b: Column) -> list[Column]:
    """The inverse of subtract_green."""
    return [F.pmod(r + g, F.lit(256)).alias("r"), g.alias("g"), F.pmod(b + g, F.lit(256)).alias("b")]


def add_color_transform(r: Column, g: Column, b: Column, green_to_red: Column, green_to_blue: Column, red_to_blue: Column) -> list[Column]:
    """Undoes VP8L's colour transform with a block's factors, all bytes taken as signed where they are multiplied."""
    signed = lambda v: F.when(v > 127, v - 256).otherwise(v)
    delta = lambda t, c: F.shiftright(signed(t) * signed(c), 5)
    red = F.pmod(r + delta(green_to_red, g), F.lit(256))
    blue = F.pmod(b + delta(green_to_blue, g) + delta(red_to_blue, red), F.lit(256))
    return [red.cast("int").alias("r"), g.alias("g"), blue.cast("int").alias("b")]
