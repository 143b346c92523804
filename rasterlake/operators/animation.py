"""Animation: what is on the canvas at each frame, from what each frame draws.

Pixels of the canvas are independent of each other, so composition is a window over the frames of one pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite_keep(pixels: DataFrame) -> DataFrame:
    """Frames that stay on the canvas (GIF disposal 0 and 1): a clear pixel shows the last one drawn there, if any."""
    place = Window.partitionBy("image_id", "y", "x").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    drawn = F.when(F.col("a") > 0, F.struct("r", "g", "b", "a"))
    seen = F.coalesce(F.last(drawn, ignorenulls=True).over(place), F.struct(*[F.lit(0).alias(c) for c in "rgba"]))
    return pixels.withColumn("seen", seen).select("image_id", "frame_idx", "y", "x", *[F.col(f"seen.{c}").cast("int").alias(c) for c in "rgba"])


def blend(over: dict[str, Column], under: dict[str, Column]) -> list[Column]:
    """WebP's blending of a pixel over another in whole numbers: an opaque pixel replaces, and where the result would have no
    alpha the other stays. Colours are bytes, so they wrap."""
    alpha = over["a"] + F.floor(under["a"] * (255 - over["a"]) / 255)
    part = lambda c: F.floor(under[c] * under["a"] * (255 - over["a"]) / 255)
    mixed = lambda c: F.floor((over[c] * over["a"] + part(c)) / F.greatest(alpha, F.lit(1))) % 256
    out = [F.when(over["a"] == 255, over[c]).when(alpha == 0, under[c]).otherwise(mixed(c)).cast("int").alias(c) for c in "rgb"]
    return [*out, F.when(over["a"] == 255, 255).when(alpha == 0, under["a"]).otherwise(alpha).cast("int").alias("a")]


def gif_canvas(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """The whole canvas at each frame: image_id, frame_idx, y, x, word (0xRRGGBBAA).

    frames: image_id, frame_idx, left, top, width, height, disposal, canvas_width, canvas_height, background (a word).
    pixels: image_id, frame_idx, y, x in the frame, word, of which those without alpha are not drawn.

    A frame shows what it draws, over what the frames before it have left: what they drew if they are kept (disposal 0 and
    1), the background all over their rectangle (2), or nothing (3, which takes back what it drew). So a place's colour is
    the last thing left there, which is a window over the frames of one place.
    """
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    places = frames.withColumn("cy", side("canvas_height")).withColumn("cx", side("canvas_width"))
    places = places.withColumns({"y": F.col("cy") - F.col("top"), "x": F.col("cx") - F.col("left")})
    inside = F.col("y").between(0, F.col("height") - 1) & F.col("x").between(0, F.col("width") - 1)
    drawn = places.join(pixels.where(F.col("word") % 256 > 0), ["image_id", "frame_idx", "y", "x"], "left").withColumn("word", F.when(inside, F.col("word")))
    left = F.when(F.col("disposal") == 2, F.when(inside, F.col("background"))).when(F.col("disposal") != 3, F.col("word"))
    before = Window.partitionBy("image_id", "cy", "cx").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.coalesce("word", F.last(left, ignorenulls=True).over(before), "background")
    return drawn.select("image_id", "frame_idx", F.col("cy").alias("y"), F.col("cx").alias("x"), shown.alias("word"))


def over_canvas(canvas: np.ndarray, part: np.ndarray) -> np.ndarray:
    """blend for arrays of pixels."""
    s, d = part.astype(np.int64), canvas.astype(np.int64)
    sa, da = s[..., 3:], d[..., 3:]
    alpha = sa + da * (255 - sa) // 255
    color = (s[..., :3] * sa + d[..., :3] * da * (255 - sa) // 255) // np.maximum(alpha, 1) % 256
    mixed = np.where(alpha > 0, np.concatenate([color, alpha], axis=-1), d)
    return np.where(sa == 255, s, mixed).astype(np.uint8)


def webp_canvases(images: DataFrame) -> DataFrame:
    """images (image_id, width, height, background, frames) with frames replaced by the whole canvas at each frame.

    background is a word (0xRRGGBBAA). frames: array<struct<left, top, width, height, blend, dispose, rgba>>, whose rectangles
    are within the canvas. A frame's rectangle is cleared to the background before the next frame if it says dispose; a
    frame that does not blend replaces its rectangle. Each image is by itself, so this is a narrow pass in Arrow batches.
    """

    def run(width: pd.Series, height: pd.Series, background: pd.Series, frames: pd.Series) -> pd.Series:
        out = []
        for w, h, color, own in zip(width, height, background, frames, strict=True):
            clear = np.frombuffer(int(color).to_bytes(4, "big"), dtype=np.uint8)
            canvas, shown, old = np.tile(clear, (h, w, 1)), [], None
            for f in own:
                if old is not None:
                    canvas[old] = clear
                at = slice(f["top"], f["top"] + f["height"]), slice(f["left"], f["left"] + f["width"])
                part = np.frombuffer(f["rgba"], dtype=np.uint8).reshape(f["height"], f["width"], 4)
                canvas[at] = over_canvas(canvas[at], part) if f["blend"] else part
                shown.append(canvas.tobytes())
                old = at if f["dispose"] else None
            out.append(shown)
        return pd.Series(out, dtype=object)

    drawn = F.pandas_udf(run, "array<binary>")("width", "height", "background", "frames")
    return images.withColumn("frames", drawn)


def durations(frames: DataFrame, page: int = 4096) -> DataFrame:
    """Frames (image_id, frame_idx, at_us) with duration_us: the time to the next frame, 0 for the last, in whole
    hundredths of a second as GIF keeps it.

    Numbers are cut into pages: windows are over one page, whose last frame looks to the first one of the next page that has
    any. So an image of any number of frames is dealt over many tasks; one row a page meets in an image's window.
    """
    paged = frames.withColumn("__page", F.floor(F.col("frame_idx") / page))
    first = paged.groupBy("image_id", "__page").agg(F.min_by("at_us", "frame_idx").alias("__first"))
    ahead = first.select("image_id", "__page", F.lead("__first").over(Window.partitionBy("image_id").orderBy("__page")).alias("__ahead"))
    met = paged.join(ahead, paged["__page"].eqNullSafe(ahead["__page"]) & paged["image_id"].eqNullSafe(ahead["image_id"]), "left").select(paged["*"], "__ahead")
    after = F.lead("at_us").over(Window.partitionBy("image_id", "__page").orderBy("frame_idx"))
    gap = F.coalesce(after, F.col("__ahead")) - F.col("at_us")
    return met.withColumn("duration_us", (F.floor(F.coalesce(gap, F.lit(0)) / 10_000) * 10_000).cast("long")).drop("__page", "__ahead")
