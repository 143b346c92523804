"""images, frames and pixels, and the ways between them.

images: image_id, has_alpha, loop_count, frames array<struct<width, height, duration_us, rgba>>
frames: image_id, frame_idx, width, height, duration_us, rgba
pixels: image_id, frame_idx, y, x, r, g, b, a
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.rgba import pack, pixel_word, unpack
from rasterlake.operators.resize import resize_arrays

FRAME = "struct<width:int,height:int,duration_us:bigint,rgba:binary>"


def frames_of(images: DataFrame) -> DataFrame:
    """One row for each frame; a narrow operation."""
    other = [c for c in images.columns if c != "frames"]
    return images.select(*other, F.posexplode("frames").alias("frame_idx", "f")).select(*other, "frame_idx", "f.*")


def images_of(frames: DataFrame) -> DataFrame:
    """Frames gathered by image, in order; a group is one file's frames."""
    own = F.struct("frame_idx", F.struct("width", "height", "duration_us", "rgba").alias("f"))
    return frames.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["f"]).alias("frames"))


def pixels_of(frames: DataFrame) -> DataFrame:
    """One row for each pixel; narrow, and reads four bytes for each."""
    k = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k")
    each = frames.select("image_id", "frame_idx", "width", "rgba", k)
    word = each.select("image_id", "frame_idx", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), pixel_word(F.col("rgba"), F.col("k")).alias("w"))
    return word.select("image_id", "frame_idx", "y", "x", *unpack(F.col("w")))


def frames_from_pixels(pixels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Frames of a known size; pixels that are missing are transparent black, those beyond it are left out, and of several at one
    place the one with the largest word (0xRRGGBBAA) is taken. Rows are gathered first, then a frame's rows: a group is one row's pixels, or one
    frame's rows."""
    own = ["image_id", "frame_idx", "width", "height"]
    sized = pixels.withColumns({"width": width.cast("int"), "height": height.cast("int")})
    one = sized.groupBy(*own, "y", "x").agg(F.max(pack(F.col("r"), F.col("g"), F.col("b"), F.col("a"))).alias("word"))
    inside = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    pixel = F.when(inside, F.struct("x", F.lpad(F.hex("word"), 8, "0").alias("h")))
    rows = one.groupBy(*own, "y").agg(F.map_from_entries(F.collect_list(pixel)).alias("m"))
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.coalesce(F.try_element_at("m", x), F.lit("00000000"))), "")
    filled = rows.select(*own, F.when(F.col("y").between(0, F.col("height") - 1), F.struct("y", F.unhex(row).alias("b"))).alias("row"))
    known = filled.groupBy(*own).agg(F.map_from_entries(F.collect_list("row")).alias("m"))
    blank_row = F.unhex(F.repeat(F.lit("00000000"), F.col("width")))
    dense = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.hex(F.coalesce(F.try_element_at("m", y), blank_row)))
    return known.select(*own, F.lit(0).cast("long").alias("duration_us"), F.unhex(F.array_join(dense, "")).alias("rgba"))


def add_frame(frames: Column, frame: Column) -> Column:
    return F.array_append(frames, frame)


def insert_frame(frames: Column, at: Column, frame: Column) -> Column:
    """Inserts before place `at`, counted from 0."""
    ok = (at >= 0) & (at <= F.size(frames))
    return F.array_insert(frames, F.when(ok, at + 1).otherwise(F.raise_error(F.lit("no such place")).cast("int")).cast("int"), frame)


def remove_frame(frames: Column, at: Column) -> Column:
    """Without the frame at a place counted from 0; a place without a frame is an error, and so is removing the only one."""
    left = F.filter(frames, lambda f, i: i != at)
    error = lambda text: F.raise_error(F.lit(text)).cast(f"array<{FRAME}>")
    return F.when((at < 0) | (at >= F.size(frames)), error("no such place")).when(F.size(left) > 0, left).otherwise(error("an image needs a frame"))


def keep_root(frames: Column) -> Column:
    return F.slice(frames, 1, 1)


def scale_hotspot(x: Column, old: Column, new: Column) -> Column:
    """A hotspot's coordinate after a resize, rounded half to even."""
    return F.rint(x * new / old).cast("int")


def step_rate(rates: Column, step: Column, default: Column) -> Column:
    """Jiffies that an animated cursor shows a step; the default where no rate is given."""
    return F.coalesce(F.try_element_at(rates, (step + 1).cast("int")), default)


def milliseconds(jiffies: Column) -> Column:
    """Sixtieths of a second in milliseconds, as a double."""
    return jiffies * F.lit(1000.0 / 60.0)


def jiffies(milliseconds: Column) -> Column:
    """Milliseconds in whole sixtieths of a second, rounded half up."""
    return F.floor(milliseconds * 60.0 / 1000.0 + F.lit(0.5)).cast("long")


def step_frame(sequence: Column, step: Column, frames: Column) -> Column:
    """The frame that a step shows: by the sequence, or in turn beyond it and without one."""
    return F.coalesce(F.when(step >= 0, F.try_element_at(sequence, (step + 1).cast("int"))), step % frames)


def put_at(values: Column, at: Column, value: Column, blank: Column) -> Column:
    """An array with a value at a place counted from 0; it is made longer with blanks where it is too short."""
    known = F.coalesce(values, F.filter(F.array(blank), lambda _: F.lit(False)))
    long = F.concat(known, F.array_repeat(blank, F.greatest(at + 1 - F.size(known), F.lit(0)).cast("int")))
    return F.transform(long, lambda v, i: F.when(i == at, value).otherwise(v))


def set_step_rate(rates: Column, step: Column, rate: Column, default: Column) -> Column:
    """Jiffies of a step; steps before it that have none get the default."""
    return put_at(rates, step, rate, default)


def set_hotspot(hotspots: Column, at: Column, x: Column, y: Column) -> Column:
    """An array of (x, y) with the hotspot of one frame or entry; entries before it that have none get (0, 0). An icon that
    gets one becomes a cursor, which is the caller's column to change."""
    spot = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    return put_at(hotspots, at, spot(x, y), spot(F.lit(0), F.lit(0)))


def set_metadata(metadata: Column, kind: str, value: Column) -> Column:
    """A map of metadata by kind, with one kind set; a null map is an empty one."""
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: k != kind)
    return F.map_concat(rest, F.create_map(F.lit(kind), value))


def get_metadata(metadata: Column, kind: str) -> Column:
    """Null if there is none of the kind."""
    return F.try_element_at(metadata, F.lit(kind))


def remove_metadata(metadata: Column, kind: str) -> Column:
    return F.map_filter(metadata, lambda k, v: k != kind)


def has_metadata(metadata: Column, kind: str) -> Column:
    return F.coalesce(F.map_contains_key(metadata, kind), F.lit(False))


def resized_images(images: DataFrame, width: int, height: int, mode: str = "bilinear") -> DataFrame:
    """images (frames, ...) with all frames in one size. Other columns are carried, and `hotspots`, an array of (x, y), is scaled
    by the size of the root frame; hotspots at (0, 0) stay there. Narrow: each row is resized by itself, so rows may share
    an id, and images without frames stay as they are."""
    own = lambda c: F.transform("frames", lambda f: f[c])
    root = F.col("__root")  # by a name of its own: within a lambda, `frames` would be the new column
    new = images.withColumn("__root", F.get(F.col("frames"), F.lit(0))).withColumn("__new", resize_arrays(own("rgba"), own("width"), own("height"), width, height, mode))
    frame = lambda f, b: F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), f["duration_us"].alias("duration_us"), b.alias("rgba"))
    put = {"frames": F.zip_with("frames", "__new", frame)}
    if "hotspots" in images.columns:
        spot = lambda h: F.struct(scale_hotspot(h["x"], root["width"], F.lit(width)).alias("x"), scale_hotspot(h["y"], root["height"], F.lit(height)).alias("y"))
        put["hotspots"] = F.when(root.isNull(), F.col("hotspots")).otherwise(F.transform("hotspots", spot))
    return new.select(*[put.get(c, F.col(f"`{c}`")).alias(c) for c in images.columns])


def patched(pixels: DataFrame, patch: DataFrame) -> DataFrame:
    """pixels with those of patch (image_id, frame_idx, y, x, r, g, b, a; one for each place) in their places."""
    key = ["image_id", "frame_idx", "y", "x"]
    new = patch.select(*key, F.struct(*"rgba").alias("new"))
    return pixels.join(new, key, "left").select(*key, *[F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in "rgba"])
