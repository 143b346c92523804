import math

import numpy as np
from pyspark.sql import functions as F

from rasterlake.operators import rate


def brute_tree(grid):
    levels = [grid]
    while max(levels[-1].shape) > 1:
        g = levels[-1]
        levels.append(np.array([[g[y : y + 2, x : x + 2].min() for x in range(0, g.shape[1], 2)] for y in range(0, g.shape[0], 2)]))
    return levels


def brute_bits(levels):
    """A writer that keeps what has been sent of each node."""
    bits, sent = "", set()
    for y in range(levels[0].shape[0]):
        for x in range(levels[0].shape[1]):
            below = 0
            for k in reversed(range(len(levels))):
                node = (k, y >> k, x >> k)
                value = int(levels[k][y >> k, x >> k])
                if node not in sent:
                    bits += "0" * (value - below) + "1"
                    sent.add(node)
                below = value
    return bits


def test_tag_trees(spark):
    rng = np.random.default_rng(0)
    grids = [rng.integers(0, 20, s) for s in ((1, 1), (1, 2), (3, 1), (5, 5), (4, 8), (7, 3), (9, 16), (2, 33))] + [rng.integers(0, 200, (3, 3))]
    rows = [(i, *g.shape, y, x, int(g[y, x])) for i, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])]
    odd = [(90, 2, 2, 0, 0, 5), (90, 2, 2, 0, 0, 3), (90, 2, 2, 1, 1, None), (90, 2, 2, 2, 0, 1), (91, 0, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows + odd, "i int, height int, width int, y int, x int, value int")
    tree = rate.tag_tree(df, ["i"]).cache()
    got = {(r.i, r.level, r.y, r.x): (r.value, r.extra) for r in tree.collect()}
    want = {(90, 0, 0, 0): (3, 0), (90, 1, 0, 0): (3, 3)}
    bits = {}
    for i, g in enumerate(grids):
        levels = brute_tree(g)
        bits[i] = brute_bits(levels)
        for k, level in enumerate(levels):
            for (y, x), v in np.ndenumerate(level):
                want[i, k, y, x] = (int(v), int(v) - (int(levels[k + 1][y // 2, x // 2]) if k + 1 < len(levels) else 0))
    assert got == want
    back = {(r.i, r.y, r.x): r.value for r in rate.tag_tree_leaves(tree, ["i"]).where("i < 90").collect()}
    assert back == {(i, y, x): v for i, _, _, y, x, v in rows}
    for r in rate.tag_tree_bits(tree.where("i < 90"), ["i"]).collect():
        b = bits[r.i]
        b += "1" * (-len(b) % 8)
        assert (r.n_bits, bytes(r.content)) == (len(bits[r.i]), bytes(int(b[k : k + 8], 2) for k in range(0, len(b), 8)))


def brute_hull(rates, dists):
    """Starts anew after each point that falls out."""
    gone = {k for k, r in enumerate(rates) if r is None or r < 0 or dists[k] is None}
    first = next((k for k, r in enumerate(rates) if k not in gone and r > 0), len(rates))
    while True:
        kept = []
        for k in range(first, len(rates)):
            if k in gone:
                continue
            r, d, slope = (rates[kept[-1][0]], dists[kept[-1][0]], kept[-1][1]) if kept else (0, 0.0, None)
            more, gain = rates[k] - r, dists[k] - d
            if gain < 0 or (gain == 0 and more > 0):
                gone.add(k)
                continue
            if kept and (more <= 0 or np.float32(gain / more) >= slope):
                gone.add(kept[-1][0])
                break
            kept.append((k, np.float32(gain / more)))
        else:
            return kept


def random_passes(rng, n):
    rates = np.cumsum(rng.integers(0, 6, n)).tolist()
    dists = np.cumsum(rng.choice([0.0, 1.0, 2.5, 7.0, -1.0, 30.0], n)).tolist()
    for k in rng.choice(n, n // 6, replace=False) if n else []:
        rates[k] = -rates[k] if rng.random() < 0.7 else None
    return rates, dists


def test_hull(spark):
    rng = np.random.default_rng(1)
    cases = [random_passes(rng, int(rng.integers(0, 40))) for _ in range(400)] + [(None, None), ([], []), ([5, 5, 5], [1.0, 2.0, 2.0]), ([0, 0], [1.0, 2.0]), ([3], [None])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, rates array<int>, dists array<double>")
    out = df.select("i", rate.truncation_points(F.col("rates"), F.col("dists")).alias("p"), rate.truncation_points(F.col("rates"), F.col("dists"), last=True).alias("q")).collect()
    for r in out:
        rates, dists = cases[r.i]
        if rates is None:
            assert r.p is None
            continue
        want = brute_hull(rates, dists)
        assert [(p.idx, np.float32(p.slope)) for p in r.p] == want
        assert [(p.rate, p.dist) for p in r.p] == [(rates[k], dists[k]) for k, _ in want]
        assert all(a.slope > b.slope for a, b in zip(r.p, r.p[1:], strict=False))
        if rates and rates[-1] and rates[-1] > 0 and dists[-1] is not None:
            assert r.q[-1].idx == len(rates) - 1 and [p.idx for p in r.q if p.idx < len(rates) - 1] == [k for k, _ in want if k < len(rates) - 1]


def test_layers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    blocks = []
    for i in range(300):
        n = int(rng.integers(0, 12))
        slopes = np.sort(np.unique(np.float32(rng.choice([2.0, 3.0, 1e-3, 5e6], n) * rng.choice([1, 1, 1.0000001, rng.random()], n))))[::-1]
        rates = np.cumsum(rng.integers(1, 50, len(slopes)))
        blocks.append((i, [(k, int(r), 1.0, float(s)) for k, (r, s) in enumerate(zip(rates, slopes, strict=True))]))
    df = spark.createDataFrame(blocks, "i int, points array<struct<idx:int,rate:bigint,dist:double,slope:float>>").repartition(3)
    steps = sorted(((np.float32(s), r - (p[k - 1][1] if k else 0)) for _, p in blocks for k, r, _, s in p), reverse=True)
    total = sum(b for _, b in steps)
    budgets = [0, 10, total // 7, total // 3, total // 2, total - 1, total, 10 * total]
    want = []
    for budget in budgets:
        best, used = math.inf, 0
        for slope in sorted({s for s, _ in steps}, reverse=True):
            used += sum(b for s, b in steps if s == slope)
            if used > budget:
                break
            best = float(slope)
        want.append(best)
    expected = {(i, layer, *max((k, r) for k, r, _, s in p if s >= t)) for i, p in blocks for layer, t in enumerate(want) if any(s >= t for _, _, _, s in p)}
    for bins in (rate.BINS, 5):
        monkeypatch.setattr(rate, "BINS", bins)
        flat = df.select(F.explode("points").alias("p")).select("p.slope", F.lit(0).alias("bytes"))
        assert rate.layer_thresholds(flat.limit(0), [5]) == [math.inf]
        assert {tuple(r) for r in rate.layers(df, ["i"], budgets).collect()} == expected
    assert rate.layers(df, ["i"], []).count() == 0
