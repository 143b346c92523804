"""Blocks of samples and their transforms: JPEG's cosine transform, VP8's, and VP8's Walsh-Hadamard transform.

A block is one row with an array of its samples by rows; pixels are never shuffled. Transforms work on all blocks of an Arrow
batch at once, the cosine transform of 8 x 8 in single precision and in a fixed order of operations, the others in integers.
Arrays of another length, and with nulls, give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors of the cosine transform's steps, forward and back, in single precision.
HALF_ROOT = np.float32(0.707107)
FORWARD = {"even": (0.541196, 1.306563), "outer": (1.175876, 0.785695), "inner": (1.387040, 0.275899)}
BACK = {"all": 1.175875602, "z": (-0.899976223, -2.562915447, -1.961570560, -0.390180644), "odd": (1.501321110, 3.072711026, 2.053119869, 0.298631336), "even": (0.541196100, -1.847759065, 0.765366865)}
#: VP8's factors in 1/65,536 and in 1/4,096 (back and forward), and what its forward transform adds before it cuts.
COSINE, SINE, FORWARD_4, ADDED = 20091, 35468, (2217, 5352), (14500, 7500, 7, 12000, 51000)

f32 = np.float32


def forward8(x: list[np.ndarray]) -> list[np.ndarray]:
    """Eight rows, or columns, of cosine coefficients, not yet scaled."""
    s, d = [x[k] + x[7 - k] for k in range(4)], [x[k] - x[7 - k] for k in range(4)]  # sums, and differences, of mirrored places
    near, far = s[0] + s[3], s[0] - s[3]
    mid, off = s[1] + s[2], s[1] - s[2]

    def turned(a: np.ndarray, b: np.ndarray, by: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        return f32(by[0]) * a + f32(by[1]) * b, f32(by[0]) * b - f32(by[1]) * a

    two, six = turned(off, far, FORWARD["even"])
    p, q = turned(d[3], d[0], FORWARD["outer"])
    r, t = turned(d[2], d[1], FORWARD["inner"])
    u, v = (q + r) * HALF_ROOT, (p + t) * HALF_ROOT
    return [near + mid, u + v, two, q - r, near - mid, p - t, six, u - v]


def back8(y: list[np.ndarray]) -> list[np.ndarray]:
    """The inverse of forward8, scaled by eight for each direction."""
    z = [y[1] + y[7], y[3] + y[5], y[3] + y[7], y[1] + y[5]]
    every = (z[0] + z[1]) * f32(BACK["all"])
    z0, z1 = z[0] * f32(BACK["z"][0]), z[1] * f32(BACK["z"][1])
    z2, z3 = z[2] * f32(BACK["z"][2]) + every, z[3] * f32(BACK["z"][3]) + every
    odd = [y[k] * f32(by) + a + b for k, by, a, b in zip((1, 3, 5, 7), BACK["odd"], (z0, z1, z1, z0), (z3, z2, z3, z2), strict=True)]
    both = (y[2] + y[6]) * f32(BACK["even"][0])
    lower, upper = both + y[6] * f32(BACK["even"][1]), both + y[2] * f32(BACK["even"][2])
    plus, minus = y[0] + y[4], y[0] - y[4]
    even = [plus + upper, minus + lower, minus - lower, plus - upper]
    return [e + o for e, o in zip(even, odd, strict=True)] + [e - o for e, o in zip(even[::-1], odd[::-1], strict=True)]


def both_ways(step, blocks: np.ndarray) -> np.ndarray:
    """step along the rows, then along the columns, of (n, 8, 8) blocks."""
    for _ in range(2):
        turned = blocks.transpose(0, 2, 1)
        blocks = np.stack(step([turned[:, k] for k in range(8)]), axis=1)
    return blocks * f32(0.125)


def vp8_forward(b: np.ndarray) -> np.ndarray:
    cos, sin = FORWARD_4
    x = [b[:, :, k] * 8 for k in range(4)]
    a, b_, c, d = x[0] + x[3], x[1] + x[2], x[1] - x[2], x[0] - x[3]
    y = np.stack([a + b_, (c * cos + d * sin + ADDED[0]) >> 12, a - b_, (d * cos - c * sin + ADDED[1]) >> 12], axis=2)
    a, b_, c, d = y[:, 0] + y[:, 3], y[:, 1] + y[:, 2], y[:, 1] - y[:, 2], y[:, 0] - y[:, 3]
    return np.stack([(a + b_ + ADDED[2]) >> 4, ((c * cos + d * sin + ADDED[3]) >> 16) + (d != 0), (a - b_ + ADDED[2]) >> 4, (d * cos - c * sin + ADDED[4]) >> 16], axis=1)


def vp8_back(b: np.ndarray) -> np.ndarray:
    grown, cut = lambda v: v + (v * COSINE >> 16), lambda v: v * SINE >> 16

    def step(x: list[np.ndarray]) -> list[np.ndarray]:
        a, b_, c, d = x[0] + x[2], x[0] - x[2], cut(x[1]) - grown(x[3]), grown(x[1]) + cut(x[3])
        return [a + d, b_ + c, b_ - c, a - d]

    y = np.stack(step([b[:, k] for k in range(4)]), axis=1)
    return np.stack([(v + 4) >> 3 for v in step([y[:, :, k] for k in range(4)])], axis=2)


def walsh(x: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d = x[0] + x[3], x[1] + x[2], x[1] - x[2], x[0] - x[3]
    return [a + b, c + d, a - b, d - c]


def walsh_forward(b: np.ndarray) -> np.ndarray:
    """Halved away from zero if positive, towards it if not."""
    y = np.stack(walsh([b[:, :, k] for k in range(4)]), axis=2)
    y = np.stack(walsh([y[:, k] for k in range(4)]), axis=1)
    return np.where(y > 0, (y + 1) >> 1, -(-y >> 1))


def walsh_back(b: np.ndarray) -> np.ndarray:
    y = np.stack(walsh([b[:, k] for k in range(4)]), axis=1)
    return (np.stack(walsh([y[:, :, k] for k in range(4)]), axis=2) + 3) >> 3


#: By name: side, numbers of samples, function of (n, side, side) blocks.
KINDS = {
    "dct8": (8, np.float32, lambda b: both_ways(forward8, b)), "idct8": (8, np.float32, lambda b: both_ways(back8, b)),
    "dct4": (4, np.int64, vp8_forward), "idct4": (4, np.int64, vp8_back), "wht4": (4, np.int64, walsh_forward), "iwht4": (4, np.int64, walsh_back),
}


def whole_lists(arrays: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have `length` numbers and no null, their numbers)."""
    sizes = arrays.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = sizes == length
    flat = arrays.filter(pa.array(ok)).flatten()
    if flat.null_count:
        good = ~np.asarray(flat.is_null()).reshape(-1, length).any(axis=1)
        ok[np.flatnonzero(ok)[~good]] = False
        flat = arrays.filter(pa.array(ok)).flatten()
    return ok, flat.to_numpy(zero_copy_only=False).reshape(-1, length)


def as_lists(ok: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of values for the rows that are ok, null for the others."""
    offsets = np.concatenate([[0], np.cumsum(ok * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind), mask=pa.array(~ok))


def transformed(samples: Column, kind: str) -> Column:
    """The block's transform, of a kind of KINDS: arrays of floats for 8 x 8, of whole numbers for 4 x 4."""
    side, number, step = KINDS[kind]
    own = pa.float32() if number is np.float32 else pa.int64()

    def run(arrays: pa.Array) -> pa.Array:
        ok, values = whole_lists(arrays, side * side)
        done = step(values.astype(number).reshape(-1, side, side))
        return as_lists(ok, done.reshape(len(values), side * side).astype(number), own)

    return F.arrow_udf(run, "array<float>" if side == 8 else "array<bigint>")(samples)


def frame_blocks(frames: DataFrame, channel: str = "r", side: int = 8) -> DataFrame:
    """image_id, frame_idx, n (by rows), by, bx, samples: a channel of frames in blocks of side x side. Blocks that reach beyond the frame repeat
    its last column and row. Frames without pixels, or of another length than their sides say, have no blocks."""

    def run(rgba: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows, counts = [], []
        for b, w, h in zip(rgba.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            if not b or not w or not h or len(b) != w * h * 4:
                counts.append(0)
                continue
            px = np.frombuffer(b, dtype=np.uint8).reshape(h, w, 4)[..., "rgba".index(channel)]
            down, across = -(-h // side), -(-w // side)
            full = np.pad(px, ((0, down * side - h), (0, across * side - w)), mode="edge").reshape(down, side, across, side).transpose(0, 2, 1, 3)
            rows.append((np.arange(down * across), np.repeat(np.arange(down), across), np.tile(np.arange(across), down), full.reshape(-1, side * side)))
            counts.append(down * across)
        none = (np.zeros(0, dtype=np.int32),) * 3 + (np.zeros((0, side * side), dtype=np.int32),)
        *places, samples = map(np.concatenate, zip(*rows, none, strict=True))
        own = as_lists(np.ones(len(samples), dtype=bool), samples.astype(np.int32), pa.int32())
        blocks = pa.StructArray.from_arrays([*[pa.array(p, pa.int32()) for p in places], own], ["n", "by", "bx", "samples"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), blocks)

    cut = F.arrow_udf(run, "array<struct<n: int, by: int, bx: int, samples: array<int>>>")
    return frames.select("image_id", "frame_idx", F.explode(cut("rgba", "width", "height")).alias("b")).select("image_id", "frame_idx", "b.*")


def zigzag_order() -> list[int]:
    """The places of a block of 8 x 8 in the order in which they are sent: by diagonals, in turn upwards and downwards."""
    places = [(y, x) for y in range(8) for x in range(8)]
    return [y * 8 + x for y, x in sorted(places, key=lambda p: (p[0] + p[1], p[1] if sum(p) % 2 == 0 else p[0]))]


def quantised(coefficients: Column, table: list[int]) -> Column:
    """Coefficients of 8 x 8 in zig-zag order, over the table's steps (by rows) in single precision, rounded half to even."""
    order = zigzag_order()

    def run(arrays: pa.Array) -> pa.Array:
        ok, values = whole_lists(arrays, 64)
        done = np.rint(values.astype(np.float32)[:, order] / np.array(table, dtype=np.float32)[order])
        return as_lists(ok, done.astype(np.int32), pa.int32())

    return F.arrow_udf(run, "array<int>")(coefficients)


def jpeg_blocks(frames: DataFrame, table: list[int], channel: str = "r") -> DataFrame:
    """image_id, frame_idx, n (the block's number, by rows), q: a channel's blocks as a JPEG coder sends them, with 128 taken from
    the samples before the transform."""
    moved = F.transform("samples", lambda v: v - 128)
    return frame_blocks(frames, channel).select("image_id", "frame_idx", "n", quantised(transformed(moved, "dct8"), table).alias("q"))
