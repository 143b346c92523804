"""Resizing frames: nearest, bilinear, bicubic and area average.

Each frame is resized by itself, so this is a narrow operation over rows; within a batch, frames of one size are resized
together as arrays. Sums are in double precision in a fixed order, rows first, so results do not depend on partitioning.
Channels are not multiplied by alpha. Bilinear and bicubic average areas if either side becomes smaller.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("nearest", "bilinear", "bicubic")


def clamp_round(v: np.ndarray) -> np.ndarray:
    return np.where(v < 0, 0, np.where(v > 255, 255, np.floor(v + 0.5))).astype(np.uint8)


def nearest(px: np.ndarray, height: int, width: int) -> np.ndarray:
    pick = [np.minimum((np.arange(new) * (old / new)).astype(np.int64), old - 1) for old, new in zip(px.shape[1:3], (height, width), strict=True)]
    return px[:, pick[0][:, None], pick[1][None, :]]


def overlaps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths): the source places that each target place covers, in order, padded with length 0."""
    low = np.arange(new) * (old / new)
    high = np.minimum(np.arange(1, new + 1) * (old / new), old)
    first = low.astype(np.int64)
    place = first[:, None] + np.arange(int((np.ceil(high) - first).max()))[None, :]
    length = np.minimum(place + 1, high[:, None]) - np.maximum(place, low[:, None])
    return np.minimum(place, old - 1), np.where(place < old, np.maximum(length, 0), 0)


def area(px: np.ndarray, height: int, width: int) -> np.ndarray:
    (ys, hs), (xs, ws) = overlaps(px.shape[1], height), overlaps(px.shape[2], width)
    total, weights = np.zeros((len(px), height, width, 4)), np.zeros((height, width))
    for i in range(ys.shape[1]):
        for j in range(xs.shape[1]):
            w = ws[None, :, j] * hs[:, i, None]
            total += px[:, ys[:, i, None], xs[None, :, j]] * w[None, :, :, None]
            weights += w
    return clamp_round(total / weights[None, :, :, None])


def spread(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(source place, fraction to the next) of each target place, corners on corners."""
    at = np.arange(new) * ((old - 1) / max(new - 1, 1))
    return at.astype(np.int64), at - at.astype(np.int64)


def cubic(x: np.ndarray) -> np.ndarray:
    """Catmull-Rom weights."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def interpolate(px: np.ndarray, height: int, width: int, taps: range, weight) -> np.ndarray:
    (y, fy), (x, fx) = spread(px.shape[1], height), spread(px.shape[2], width)
    total = np.zeros((len(px), height, width, 4))
    for j in taps:
        row = np.clip(y + j, 0, px.shape[1] - 1)
        for i in taps:
            w = weight(i, fx)[None, :] * weight(j, fy)[:, None]
            total += px[:, row[:, None], np.clip(x + i, 0, px.shape[2] - 1)[None, :]] * w[None, :, :, None]
    return clamp_round(total)


def resize_array(px: np.ndarray, height: int, width: int, mode: str) -> np.ndarray:
    """(frames, height, width, 4) bytes in another size."""
    if mode == "nearest":
        return nearest(px, height, width)
    if height < px.shape[1] or width < px.shape[2]:
        return area(px, height, width)
    if mode == "bilinear":
        return interpolate(px, height, width, range(2), lambda k, f: f if k else 1.0 - f)
    return interpolate(px, height, width, range(-1, 3), lambda k, f: cubic(k - f))


def checked(width: int, height: int, mode: str) -> None:
    if width <= 0 or height <= 0 or mode not in MODES:
        raise ValueError("width and height must be positive, mode one of " + ", ".join(MODES))


def by_size(rgba: pd.Series, w: pd.Series, h: pd.Series, work, most: int = 1) -> pd.Series:
    """work((n, h, w, 4) bytes) for the RGBA buffers of each size together, some 16 Mpixel (of a frame's, or of `most`) at a time;
    null stays null."""
    out = pd.Series([None] * len(rgba), dtype=object, index=rgba.index)
    known = rgba.notna()
    for (ww, hh), at in rgba[known].groupby([w[known], h[known]]).groups.items():
        step = max(1, (1 << 24) // max(ww * hh, most))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            px = np.frombuffer(b"".join(rgba[part]), dtype=np.uint8).reshape(len(part), hh, ww, 4)
            for k, frame in zip(part, work(px), strict=True):
                out[k] = frame.tobytes()
    return out


def resized_buffers(rgba: pd.Series, w: pd.Series, h: pd.Series, width: int, height: int, mode: str) -> pd.Series:
    """RGBA buffers of w x h pixels in another size; null stays null."""
    return by_size(rgba, w, h, lambda px: resize_array(px, height, width, mode), width * height)


def resize(frames: DataFrame, width: int, height: int, mode: str = "bilinear") -> DataFrame:
    """frames with another size; durations and all other columns stay."""
    checked(width, height, mode)

    def run(rgba: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return resized_buffers(rgba, w, h, width, height, mode)

    resized = F.pandas_udf(run, T.BinaryType())("rgba", "width", "height")
    return frames.withColumns({"rgba": resized, "width": F.lit(width), "height": F.lit(height)}).select(*frames.columns)


def resize_arrays(rgba: Column, w: Column, h: Column, width: int, height: int, mode: str = "bilinear") -> Column:
    """Arrays of buffers in another size, those of each row in their order; arrays may be empty or null."""
    checked(width, height, mode)

    def run(rgba: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        flat = lambda s: pd.Series([v for x in s if x is not None for v in x], dtype=object)
        new = list(resized_buffers(flat(rgba), flat(w), flat(h), width, height, mode))
        ends = np.cumsum([0 if x is None else len(x) for x in rgba])
        return pd.Series([None if x is None else new[end - len(x) : end] for x, end in zip(rgba, ends, strict=True)])

    return F.pandas_udf(run, T.ArrayType(T.BinaryType()))(rgba, w, h)
