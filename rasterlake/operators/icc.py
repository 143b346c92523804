"""Colour profiles of three curves and a matrix: what profiles hold, and pixels of theirs in sRGB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.headers import big, signed32
from rasterlake.functions.rgba import made

#: The matrix from a profile's connection space to linear sRGB, by rows; sRGB's curve.
SRGB = ((3.1337, -1.6173, -0.4907), (-0.9785, 1.9162, 0.0334), (0.0720, -0.2290, 1.4056))
CUT, SLOPE, SCALE, LESS, EXPONENT = 0.0031308, 12.92, 1.055, 0.055, 1.0 / 2.4
#: Profiles are broadcast if all their curves together have at most so many points.
POINTS = 4_000_000


def icc_profiles(files: DataFrame) -> DataFrame:
    """files without content, with curves (three arrays of 16-bit points), colorants (three arrays of x, y, z in 1/65,536) and error,
    null for a profile that has them all.

    Errors: 'short' (under 132 bytes), 'no profile' (without its signature), 'no curves or colorants' (a tag is missing, of another
    type, or reaches beyond the content). A null content is 'short'.
    """
    other, c = [n for n in files.columns if n != "content"], F.col("content")
    many = F.least(big(c, 128, 4), F.floor((F.length(c) - 132) / 12))
    places = F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))
    tags = F.transform(places, lambda k: F.struct(F.decode(F.substring(c, (k * 12 + 133).cast("int"), F.lit(4)), "ISO-8859-1").alias("name"), big(c, k * 12 + 136, 4).alias("at"), big(c, k * 12 + 140, 4).alias("size")))
    known = files.select("*", made(__tags=F.when(F.length(c) >= 132, tags)))
    at = lambda name: F.get(F.filter("__tags", lambda t: (t["name"] == name) & (t["at"] + t["size"] <= F.length(c))), F.lit(0))
    known = known.select("*", made(**{f"__{n}{kind}": at(n + kind) for n in "rgb" for kind in ("TRC", "XYZ")}))

    def kind_of(t: Column) -> Column:
        return F.decode(F.substring(c, (t["at"] + 1).cast("int"), F.lit(4)), "ISO-8859-1")

    def curve(t: Column) -> Column:
        n = big(c, t["at"] + 8, 4)
        fits = (kind_of(t) == "curv") & (t["size"] >= 12) & (n * 2 + 12 <= t["size"])
        index = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.when(fits, F.transform(index, lambda k: big(c, t["at"] + 12 + k * 2, 2).cast("int")))

    def colorant(t: Column) -> Column:
        return F.when((kind_of(t) == "XYZ ") & (t["size"] >= 20), F.array(*[signed32(big(c, t["at"] + 8 + 4 * k, 4)).cast("int") for k in range(3)]))

    known = known.select("*", made(curves=F.array(*[curve(F.col(f"__{n}TRC")) for n in "rgb"]), colorants=F.array(*[colorant(F.col(f"__{n}XYZ")) for n in "rgb"])))
    missing = F.exists("curves", lambda x: x.isNull()) | F.exists("colorants", lambda x: x.isNull())
    error = F.when(F.col("__tags").isNull(), "short").when(F.hex(F.substring(c, 37, 4)) != "61637370", "no profile").when(missing, "no curves or colorants")
    return known.select(*other, made(__error=error), "curves", "colorants").select(*other, *[F.when(F.col("__error").isNull(), F.col(n)).alias(n) for n in ("curves", "colorants")], F.col("__error").alias("error"))


def linear(v: Column, curve: Column, most: int) -> Column:
    """Linear light, in single precision, of a sample from 0 to `most` (others are held within): a curve of one point is a power in 1/256,
    one of none is straight, and others are points at even steps, with straight lines between them."""
    held = F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(most), v))).cast("double")
    place = held * ((F.size(curve) - 1) / F.lit(float(most)))
    point = lambda k: F.get(curve, k.cast("int")) / F.lit(65535.0)
    low, high = F.floor(place), F.ceil(place)
    between = point(low) + (point(high) - point(low)) * (place - low)
    power = F.pow(held / F.lit(float(most)), F.get(curve, F.lit(0)) / F.lit(256.0))
    return F.when(F.size(curve) == 0, held / F.lit(float(most))).when(F.size(curve) == 1, power).when(low == high, point(low)).otherwise(between).cast("float")


def srgb_sample(v: Column, most: int) -> Column:
    """The sample, from 0 to `most`, of linear light in whole steps of 1 / most."""
    share = v * F.lit(1.0 / most)
    curved = F.floor(F.lit(SCALE * most) * F.pow(share, F.lit(EXPONENT)) - F.lit(LESS * most) + 0.5)
    return F.when(v <= int(CUT * most), F.floor(F.lit(SLOPE * most) * share + 0.5)).otherwise(curved).cast("int")


def profiled_to_srgb(pixels: DataFrame, profiles: DataFrame, bits: int = 8) -> DataFrame:
    """pixels (profile_id, r, g, b, ...) in sRGB, by profiles (profile_id, curves, colorants; one row each) of samples of `bits` bits.

    Pixels of a profile that is not there, or has no curves, go; null samples stay null. Profiles are broadcast if their
    curves have at most POINTS points together, else they meet by shuffle. Curves are read where they are; no table
    of all samples is made.
    """
    most = (1 << bits) - 1
    own = profiles.where("curves is not null and colorants is not null").select("profile_id", F.col("curves").alias("__c"), F.col("colorants").alias("__x"))
    points = own.agg(F.sum(F.aggregate("__c", F.lit(0), lambda t, c: t + F.size(c)) + 9)).first()[0] or 0
    met = pixels.join(F.broadcast(own) if points <= POINTS else own, "profile_id")
    light = {f"__{n}": linear(F.col(n), F.get(F.col("__c"), F.lit(k)), most) for k, n in enumerate("rgb")}
    met = met.select("*", made(**light))
    number = lambda k, axis: F.get(F.get(F.col("__x"), F.lit(k)), F.lit(axis)) / F.lit(65536.0)

    def mixed(row: tuple[float, float, float]) -> Column:
        factor = lambda k: F.lit(float(most)) * (F.lit(row[0]) * number(k, 0) + F.lit(row[1]) * number(k, 1) + F.lit(row[2]) * number(k, 2))
        total = factor(0) * F.col("__r").cast("double") + factor(1) * F.col("__g").cast("double") + factor(2) * F.col("__b").cast("double") + 0.5
        return F.when(total.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(most), total.cast("long"))))

    met = met.select("*", made(**{f"__s{n}": mixed(row) for n, row in zip("rgb", SRGB, strict=True)}))
    return met.select(*[srgb_sample(F.col(f"__s{c}"), most).alias(c) if c in ("r", "g", "b") else F.col(f"`{c}`") for c in pixels.columns])
