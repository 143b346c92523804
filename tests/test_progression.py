import itertools

import numpy as np
import pytest

from rasterlake.operators import progression

SCHEMA = "tile int, component int, dx int, dy int, levels int, layers int, x0 int, y0 int, x1 int, y1 int, ppx array<int>, ppy array<int>"


def up(a, b):
    return -(-a // b)


def precincts(c, r):
    """(y, x) of each precinct by rows, as the samples of the resolution say."""
    _, _, dx, dy, levels, _, x0, y0, x1, y1, ppx, ppy = c
    log = lambda p: 15 if not p else p[min(r, len(p) - 1)]
    out = []
    lines = []
    for d, a, b, p in ((dy, y0, y1, 1 << log(ppy)), (dx, x0, x1, 1 << log(ppx))):
        low, high = up(up(a, d), 1 << levels - r), up(up(b, d), 1 << levels - r)
        cells = sorted({v // p for v in range(low, high)})
        lines.append([a if k == cells[0] and low % (d * p) else k * d * p << levels - r for k in cells])
    out = list(itertools.product(*lines))
    return out


def nested(tile, order):
    """The packets in the loops of each order."""
    layers, levels = max(c[5] for c in tile), max(c[4] for c in tile)
    at = {(c[1], r): precincts(c, r) for c in tile for r in range(c[4] + 1)}
    ys, xs = (sorted({p[k] for own in at.values() for p in own}) for k in (0, 1))
    comps = sorted(tile, key=lambda c: c[1])
    has = lambda c, r: r <= c[4]
    if order == 0:
        return [(layer, r, c[1], p) for layer in range(layers) for r in range(levels + 1) for c in comps if has(c, r) and layer < c[5] for p in range(len(at[c[1], r]))]
    if order == 1:
        return [(layer, r, c[1], p) for r in range(levels + 1) for layer in range(layers) for c in comps if has(c, r) and layer < c[5] for p in range(len(at[c[1], r]))]
    here = lambda c, r, y, x: [(layer, r, c[1], p) for p, place in enumerate(at[c[1], r]) if place == (y, x) for layer in range(c[5])]
    if order == 2:
        return [k for r in range(levels + 1) for y in ys for x in xs for c in comps if has(c, r) for k in here(c, r, y, x)]
    if order == 3:
        return [k for y in ys for x in xs for c in comps for r in range(c[4] + 1) for k in here(c, r, y, x)]
    return [k for c in comps for y in ys for x in xs for r in range(c[4] + 1) for k in here(c, r, y, x)]


@pytest.fixture(scope="module")
def tiles():
    rng = np.random.default_rng(0)
    out = []
    for t in range(25):
        x0, y0 = (int(v) for v in rng.integers(0, 40, 2)) if t % 3 else (0, 0)
        w, h = (int(v) for v in rng.integers(1, 90, 2))
        tile = []
        for c in range(int(rng.integers(1, 4))):
            levels = int(rng.integers(0, 4))
            logs = lambda n: rng.integers(2, 6, n).tolist()
            n = int(rng.integers(0, levels + 2))
            tile.append((t, c, *map(int, rng.choice([1, 1, 2, 3], 2)), levels, int(rng.integers(1, 4)), x0, y0, x0 + w, y0 + h, logs(n) if n else None, logs(n) if n else []))
        out.append(tile)
    return out


@pytest.mark.parametrize("order", range(5))
def test_orders(spark, tiles, order):
    df = spark.createDataFrame([c for t in tiles for c in t], SCHEMA).repartition(3)
    got = {}
    for r in progression.in_order(progression.packets(df, ["tile"]), ["tile"], order).orderBy("tile", "place").collect():
        got.setdefault(r.tile, []).append((r.layer, r.resolution, r.component, r.precinct))
    assert got == {t[0][0]: nested(t, order) for t in tiles if nested(t, order)}


def test_nothing_to_send(spark):
    rows = [(1, 0, 1, 1, 2, 0, 0, 0, 8, 8, None, None), (2, 0, 4, 4, 0, 1, 1, 1, 3, 3, None, None)]
    assert progression.packets(spark.createDataFrame(rows, SCHEMA), ["tile"]).count() == 0
