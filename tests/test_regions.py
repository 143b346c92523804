import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import icc, regions, transforms


def needed(x, y, w, h, size, levels):
    """The coefficients that make any sample of the rectangle, by changing each one and looking at the samples of the 5/3 wavelet
    without rounding."""

    def synth(low, high, n):
        out = np.zeros(n)
        out[1::2], out[::2] = high, low
        d = lambda k: out[k] if 0 <= k < n else out[n - 2 if k >= n else 1] if n > 1 else 0
        even = np.array([out[k] - (d(k - 1) + d(k + 1)) / 4 for k in range(0, n, 2)])
        out[::2] = even
        return np.array([out[k] if k % 2 == 0 else out[k] + (out[k - 1] + (out[k + 1] if k + 1 < n else out[k - 1])) / 2 for k in range(n)])

    used = {}
    inside = np.zeros(size, dtype=bool)
    inside[y : y + h, x : x + w] = True
    for level in range(1, levels + 1):
        rows, cols = inside.shape
        reach = []
        for n in (rows, cols):
            m = np.zeros((n, n))
            for k in range(n):
                unit = np.zeros(n)
                unit[k] = 1
                m[k] = synth(unit[::2], unit[1::2], n)
            reach.append(m != 0)
        hit = (reach[0].astype(int) @ inside.astype(int) @ reach[1].T.astype(int)) > 0
        used |= {(level, ("H" if b else "L") + ("H" if a else "L")): hit[a::2, b::2] for a in (0, 1) for b in (0, 1)}
        if level < levels:
            inside = used.pop((level, "LL"))
    return used


def bands_of(spark, px):
    rows = [(i, 0, y, x, int(v)) for i, p in enumerate(px) for (y, x), v in np.ndenumerate(p)]
    return transforms.decompose53(spark.createDataFrame(rows, "image_id long, frame_idx int, y int, x int, v int"), "v", 2)


RECTS = "image_id long, frame_idx int, width int, height int, x int, y int, w int, h int"


def test_regions_hold_what_their_samples_need(spark):
    rng = np.random.default_rng(0)
    px = [rng.integers(0, 256, (12, 17)) for _ in range(12)]
    rows = [(i, 0, 17, 12, int(rng.integers(0, 17)), int(rng.integers(0, 12)), int(rng.integers(1, 9)), int(rng.integers(1, 9))) for i in range(12)]
    bands = bands_of(spark, px).cache()
    rects = spark.createDataFrame(rows, RECTS)
    got = {}
    for r in regions.in_regions(bands, regions.band_regions(rects, 2)).collect():
        got.setdefault(r.image_id, {})[r.level, r.band, r.y, r.x] = r.roi
    for i, (_, _, _, _, x, y, w, h) in enumerate(rows):
        want = needed(x, y, min(w, 17 - x), min(h, 12 - y), (12, 17), 2)
        for (level, band), hit in want.items():
            for (cy, cx), v in np.ndenumerate(hit):
                assert got[i][level, band, cy, cx] or not v  # none that is needed is left out
        assert sum(got[i].values()) < len(got[i]) or w * h > 20
        wide = sum(v.sum() for v in want.values())
        assert sum(got[i].values()) <= 2.5 * wide + 20


def test_scaling_and_back(spark, monkeypatch):
    monkeypatch.setattr(regions, "CELL", 3)
    rng = np.random.default_rng(1)
    px = [rng.integers(-200, 200, (9, 10)) for _ in range(3)] + [np.zeros((4, 4), dtype=int)]
    rows = [(0, 0, 10, 9, 2, 3, 4, 2), (0, 0, 10, 9, 3, 2, 4, 5), (0, 0, 10, 9, 3, 2, 4, 5), (1, 0, 10, 9, -5, -5, 6, 6), (1, 0, 10, 9, 50, 1, 3, 3), (2, 0, 10, 9, 1, 1, 0, 5), (3, 0, 4, 4, 0, 0, 4, 4)]
    bands = bands_of(spark, px).cache()
    rects = spark.createDataFrame(rows, RECTS)
    area = regions.band_regions(rects, 2).collect()
    key = ["image_id", "level", "band", "y", "x"]
    before = {tuple(r[k] for k in key): r.v for r in bands.collect()}
    up = regions.scaled_up(bands, regions.band_regions(rects, 2))
    assert up.columns == [*bands.columns, "shift"]
    seen = up.collect()
    assert len(seen) == len(before)
    for r in seen:
        v = before[tuple(r[k] for k in key)]
        held = any((a.image_id, a.level, a.band) == (r.image_id, r.level, r.band) and a.y0 <= r.y <= a.y1 and a.x0 <= r.x <= a.x1 for a in area)
        most = max(abs(w) for k, w in before.items() if k[0] == r.image_id)
        assert r.shift == most.bit_length() and r.v == (v << r.shift if v >= 0 else -(-v << r.shift)) if held else r.v == v
    assert {tuple(r[k] for k in key): r.v for r in regions.scaled_down(up).collect()} == before
    assert {a.image_id for a in area} == {0, 1, 3}
    assert regions.scaled_up(bands, regions.band_regions(rects.limit(0), 2)).where("v <> 0 and abs(v) >= shiftleft(1L, shift)").count() == 0


def profile(curves, colorants, signature=b"acsp"):
    tags = [(n + b"TRC", b"curv\0\0\0\0" + struct.pack(">I", len(c)) + b"".join(struct.pack(">H", v) for v in c)) for n, c in zip((b"r", b"g", b"b"), curves, strict=True)]
    tags += [(n + b"XYZ", b"XYZ \0\0\0\0" + struct.pack(">3i", *x)) for n, x in zip((b"r", b"g", b"b"), colorants, strict=True)]
    at, table, data = 132 + 12 * len(tags), b"", b""
    for name, own in tags:
        table += name + struct.pack(">II", at + len(data), len(own))
        data += own
    return bytes(36) + signature + bytes(88) + struct.pack(">I", len(tags)) + table + data


COLORANTS = [(28578, 14581, 912), (25241, 46981, 6361), (9376, 3973, 46799)]


def reference(rgb, curves, colorants, most):
    light = []
    for v, c in zip(rgb, curves, strict=True):
        v = min(max(v, 0), most)
        if len(c) == 0:
            y = v / most
        elif len(c) == 1:
            y = math.pow(v / most, c[0] / 256)
        else:
            t = v * ((len(c) - 1) / most)
            low, high = math.floor(t), math.ceil(t)
            y = c[low] / 65535 if low == high else c[low] / 65535 + (c[high] / 65535 - c[low] / 65535) * (t - low)
        light.append(float(np.float32(y)))
    out = []
    for row in icc.SRGB:
        m = [most * sum(s * x / 65536 for s, x in zip(row, col, strict=True)) for col in colorants]
        k = min(max(int(m[0] * light[0] + m[1] * light[1] + m[2] * light[2] + 0.5), 0), most)
        out.append(math.floor(12.92 * most * (k / most) + 0.5) if k <= int(0.0031308 * most) else math.floor(1.055 * most * math.pow(k / most, 1 / 2.4) - 0.055 * most + 0.5))
    return tuple(out)


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("points", [icc.POINTS, 0])
def test_profiled_pixels(spark, monkeypatch, bits, points):
    monkeypatch.setattr(icc, "POINTS", points)
    most = (1 << bits) - 1
    bent = [round(65535 * (k / 99) ** 2.2) for k in range(100)]
    sets = [([563], [563], [256]), (bent, bent, [0, 65535]), ([], [], []), ([7000] * 5, [0, 0], [65535, 0]), ([0, 40000, 65535], bent, [400])]
    rng = np.random.default_rng(2)
    rows = [(p, k, *map(int, rng.integers(-3, most + 4, 3))) for p in range(len(sets)) for k in range(40)] + [(p, 99, v, v, v) for p in range(len(sets)) for v in (0, most)]
    files = spark.createDataFrame([(p, profile(c, COLORANTS)) for p, c in enumerate(sets)], "profile_id int, content binary")
    known = icc.icc_profiles(files)
    assert [(r.curves, r.colorants, r.error) for r in known.orderBy("profile_id").collect()] == [([*map(list, c)], [*map(list, COLORANTS)], None) for c in sets]
    px = spark.createDataFrame([*rows, (77, 0, 1, 1, 1), (0, 5, None, 1, 1)], "profile_id int, k int, r int, g int, b int")
    out = icc.profiled_to_srgb(px, known, bits)
    got = sorted((r.profile_id, r.k, r.r, r.g, r.b) for r in out.where("r is not null").collect())
    want = sorted((p, k, *reference(rgb, sets[p], COLORANTS, most)) for p, k, *rgb in rows)
    near = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not near or bits == 16 and len(near) < 3 and all(abs(x - y) <= 1 for a, b in near for x, y in zip(a, b, strict=True))
    assert out.count() == len(rows) + 1


def test_bad_profiles(spark):
    good = profile([[563]] * 3, COLORANTS)
    cases = {"": good, "short": good[:100], "no profile": profile([[563]] * 3, COLORANTS, b"none"), "no curves or colorants": good.replace(b"gTRC", b"none")}
    rows = [(k, v) for k, v in cases.items()] + [("short", None), ("no curves or colorants", good[:-8]), ("no curves or colorants", good.replace(b"curv", b"para")), ("no curves or colorants", good[:128] + b"\xff" * 4 + good[132:200])]
    df = spark.createDataFrame(rows, "name string, content binary")
    assert all((r.error or "") == r.name and (r.curves is None) == bool(r.name) for r in icc.icc_profiles(df).collect())
    noisy = spark.createDataFrame([(k, good[:k] + bytes([255]) + good[k + 1 :]) for k in range(len(good))], "k int, content binary")
    assert icc.icc_profiles(noisy).where(F.col("error").isNotNull()).count() > 0
