"""Images derived from the tables by formulas that any SQL engine can compute.

emb_frames: a vector as an 8 x 8 grey frame; emb_rgba: the same with four channels. line_pixels: an order as one row of pixels, one for each line number.
event_frames: a user's events as the frames of an animation, with colours from type and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.rgba import clamp_byte, pack, unpack

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of parts, dealt by key over as many tasks as a shuffle has: their table is small on disk and so read by one task or
    a few, while the files made of its rows are work for all."""
    return table(spark, sf_dir, "part").select("p_partkey", *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each vector; a component v is grey clamp((v + 0.5) * 255), opaque."""
    grey = F.transform("embedding", lambda v: clamp_byte((v.cast("double") + F.lit(0.5)) * 255))
    rgba = F.unhex(F.array_join(F.transform(grey, lambda g: F.concat(F.repeat(F.lpad(F.hex(g), 2, "0"), 3), F.lit("FF"))), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("frame_idx"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(0).cast("long").alias("duration_us"), rgba.alias("rgba"))


def emb_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """emb_frames in colour: of a grey g the channels g, 255 - g, 7 g and 3 g, modulo 256."""
    grey = F.transform("embedding", lambda v: clamp_byte((v.cast("double") + F.lit(0.5)) * 255))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    rgba = F.unhex(F.array_join(F.transform(grey, lambda g: F.concat(byte(g), byte(255 - g), byte(g * 7 % 256), byte(g * 3 % 256))), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("frame_idx"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(0).cast("long").alias("duration_us"), rgba.alias("rgba"))


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one-row images: red from quantity, green from discount, blue from tax, alpha from the return flag."""
    x = F.col("l_linenumber").cast("int") - 1
    channel = lambda c, by, most: F.least(F.floor(F.col(c).cast("double") * by + F.lit(0.5)).cast("int"), F.lit(most))
    alpha = F.when(F.col("l_returnflag") == "A", 255).when(F.col("l_returnflag") == "R", 0).otherwise(128)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.lit(0).alias("frame_idx"), F.lit(0).alias("y"), x.alias("x"),
        channel("l_quantity", 5, 255).alias("r"), channel("l_discount", 2500, 255).alias("g"), channel("l_tax", 3000, 255).alias("b"), alpha.alias("a"),
    )


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_pixels with one pixel, the largest as a word, for each place of an order."""
    word = F.max(pack(F.col("r"), F.col("g"), F.col("b"), F.col("a"))).alias("w")
    one = line_pixels(spark, sf_dir).groupBy("image_id", "frame_idx", "y", "x").agg(word)
    return one.select("image_id", "frame_idx", "y", "x", *unpack(F.col("w")))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as frames of one pixel each, by event id: colour from the value, drawn where the id is even."""
    v = F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("frame_idx"), F.lit(0).alias("y"), F.lit(0).alias("x"),
        (v % 256).cast("int").alias("r"), (v * 7 % 256).cast("int").alias("g"), F.length("event_type").cast("int").alias("b"),
        F.when(F.col("event_id") % 2 == 0, 255).otherwise(0).alias("a"),
    )
