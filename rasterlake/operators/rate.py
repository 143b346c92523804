"""What JPEG 2000 decides about code blocks: tag trees, truncation points, and how many bytes each layer gets of which block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made
from rasterlake.operators.entropy import bit_streams

#: Zero bits of a tag tree that one code holds; bins of a histogram of slopes; the finest one does for two neighbouring floats.
PIECE, BINS = 32, 4096


def down(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n.cast("int"))


def tag_tree(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width, level, y, x, value, extra: the nodes of the tag trees of grids of leaves (keys, height, width, y, x, value).

    A node is the least of the up to four nodes below it; the leaves are level 0, and the last level is one node. extra is
    what a node has over its parent, or the value of the last level. Leaves without a value, and beyond the grid, are left
    out, and nodes over none have no row. Leaves of one place count as the least. One aggregate gives all levels, as each
    leaf counts for its node on each; then nodes meet their siblings, at most four.
    """
    top = F.ceil(F.log2(F.greatest("height", "width").cast("double"))).cast("int")
    inside = "value is not null and y >= 0 and x >= 0 and y < height and x < width"
    each = leaves.where(inside).withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    place = [down(F.col(c), F.col("level")).alias(c) for c in "yx"]
    nodes = each.select(*keys, "height", "width", "level", *place, "value").groupBy(*keys, "height", "width", "level", "y", "x").agg(F.min("value").alias("value"))
    siblings = Window.partitionBy(*keys, "height", "width", "level", F.floor(F.col("y") / 2), F.floor(F.col("x") / 2))
    extra = F.when(F.col("level") == top, F.col("value")).otherwise(F.col("value") - F.min("value").over(siblings))
    return nodes.withColumn("extra", extra)


def tag_tree_leaves(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The leaves that the extras of tag trees add up to: the inverse of tag_tree."""
    own = [*keys, "height", "width"]
    ancestors = tree.where("level = 0").select(*own, "y", "x", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest("height", "width").cast("double"))).cast("int"))).alias("level"))
    at = ancestors.select("*", down(F.col("y"), F.col("level")).alias("__y"), down(F.col("x"), F.col("level")).alias("__x"))
    nodes = tree.select(*own, "level", F.col("y").alias("__y"), F.col("x").alias("__x"), "extra")
    return at.join(nodes, [*own, "level", "__y", "__x"]).groupBy(*own, "y", "x").agg(F.sum("extra").alias("value"))


def tag_tree_bits(tree: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_bits, content: all values of the trees as a coder writes them that goes from leaf to leaf by rows: for each node, when
    it is first met, from the last level down, as many zeros as its extra says, and a one. Values are not negative."""
    first = F.call_function("shiftleft", F.col("y").cast("long"), F.col("level")) * F.col("width") + F.call_function("shiftleft", F.col("x").cast("long"), F.col("level"))
    n = F.col("extra") + 1
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / PIECE)), lambda k: F.struct(k.alias("k"), F.least(F.lit(PIECE).cast("long"), n - k * PIECE).cast("int").alias("length"), ((k + 1) * PIECE >= n).cast("long").alias("code")))
    each = tree.select(*keys, first.alias("leaf"), (-F.col("level")).alias("step"), F.explode(pieces).alias("p"))
    return bit_streams(each.select(*keys, "leaf", "step", "p.*"), keys, ["leaf", "step", "k"], stuff=False)


def hull(rates: list[int], dists: list[float], last: bool) -> list[tuple[int, int, float, float]]:
    """(place, rate, distortion taken away, slope) of the points of falling slope."""
    kept: list[tuple[int, int, float, float]] = []
    for k, (rate, dist) in enumerate(zip(rates, dists, strict=True)):
        if rate is None or dist is None or rate < 0 or (not kept and rate <= 0):
            continue
        while True:
            _, r, d, slope = kept[-1] if kept else (None, 0, 0.0, None)
            more, gain = rate - r, dist - d
            if gain < 0 or (gain == 0 and more > 0):
                break
            if kept and (more <= 0 or np.float32(gain / more) >= slope):
                kept.pop()
                if not kept and rate <= 0:
                    break
                continue
            kept.append((k, rate, dist, np.float32(gain / more)))
            break
    end = len(rates) - 1
    if last and end >= 0 and rates[end] and rates[end] > 0 and dists[end] is not None and (not kept or kept[-1][0] != end):
        _, r, d, _ = kept[-1] if kept else (None, 0, 0.0, None)
        kept.append((end, rates[end], dists[end], np.float32((dists[end] - d) / (rates[end] - r)) if rates[end] != r else np.float32(math.copysign(math.inf, dists[end] - d))))
    return kept


def truncation_points(rates: Column, dists: Column, last: bool = False) -> Column:
    """An array of (idx, rate, dist, slope): the passes of a code block at which it may be cut, of its passes' rates (bytes so far)
    and dists (distortion taken away so far).

    These are the corners of the upper hull, with slopes (single precision) that fall; rates that are negative or null, and
    those of 0 before any other, are no points; of points of one rate and rising dist the later one counts. With last the
    last pass is a point whatever its slope. A null array gives null.
    """

    def run(rates: pa.Array, dists: pa.Array) -> pa.Array:
        rows = [None if r is None or d is None else hull(r, d, last) for r, d in zip(rates.to_pylist(), dists.to_pylist(), strict=True)]
        return pa.array([None if r is None else [dict(zip(("idx", "rate", "dist", "slope"), p, strict=True)) for p in r] for r in rows], pa.list_(pa.struct([("idx", pa.int32()), ("rate", pa.int64()), ("dist", pa.float64()), ("slope", pa.float32())])))

    return F.arrow_udf(run, "array<struct<idx: int, rate: bigint, dist: double, slope: float>>")(rates.cast("array<bigint>"), dists.cast("array<double>"))


def layer_thresholds(steps: DataFrame, budgets: list[int]) -> list[float]:
    """For each budget the least slope at which all steps (slope, bytes) of that slope and more stay within it; infinity if
    not even the steepest do. Slopes are above 0, bytes are not negative.

    A budget has an interval of slopes and the bytes above it. Each round sums the bytes of the interval's bins, in one aggregate for
    all budgets, and goes on with the bin in which its budget is used up, until that has one slope. The driver sees at most
    BINS rows a budget and round, and no slopes are sorted.
    """
    live = {k: (0.0, math.inf, 0) for k in range(len(budgets))}  # slopes from lowest to below highest, bytes from there on
    out = [math.inf] * len(budgets)
    positive = steps.where("slope > 0").select(F.col("slope").cast("double").alias("slope"), F.col("bytes").cast("long").alias("bytes"))
    while live:
        spans = [F.struct(F.lit(k).alias("k"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b, _) in live.items()]
        s = F.col("slope")
        each = positive.withColumn("w", F.explode(F.filter(F.array(*spans), lambda w: (s >= w["low"]) & (s < w["high"]))))
        wide = F.col("w.high") == math.inf
        bin_ = F.when(wide, F.floor(F.log2("slope") * 8)).otherwise(F.least(F.lit(BINS - 1), F.floor((s - F.col("w.low")) / (F.col("w.high") - F.col("w.low")) * BINS)))
        bins = each.groupBy("w.k", bin_.alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("slope").alias("low"), F.max("slope").alias("high"))
        rows: dict[int, list] = {}
        for r in bins.collect():
            rows.setdefault(r["k"], []).append(r)
        for k in list(live):
            above = live.pop(k)[2]
            for r in sorted(rows.get(k, []), key=lambda r: -r["bin"]):
                if above + r["bytes"] <= budgets[k]:
                    above += r["bytes"]
                    out[k] = r["low"]
                    continue
                if r["low"] < r["high"]:
                    live[k] = (r["low"], math.nextafter(r["high"], math.inf), above)
                break
    return out


def layers(points: DataFrame, keys: list[str], budgets: list[int]) -> DataFrame:
    """keys, layer, idx, rate: where each code block (keys, points) is cut in each layer, whose bytes, with those of the layers before,
    stay within budgets[layer]: at the last point whose slope is at least the layer's. Blocks of which a layer has
    nothing have no row there. points are those of truncation_points; a step's bytes are what it adds to the rate."""
    added = F.transform("points", lambda p, k: F.struct(p["slope"].alias("slope"), (p["rate"] - F.coalesce(F.get(F.col("points"), k - 1)["rate"], F.lit(0))).alias("bytes")))
    thresholds = layer_thresholds(points.select(F.explode(added).alias("s")).select("s.*"), budgets)
    each = points.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(len(budgets) - 1))) if budgets else F.explode(F.array().cast("array<int>")))
    least = F.array(*[F.lit(float(t)) for t in thresholds]) if thresholds else F.array().cast("array<double>")
    cut = each.select(*keys, "layer", made(p=F.try_element_at(F.filter("points", lambda p: p["slope"].cast("double") >= F.get(least, F.col("layer"))), F.lit(-1))))
    return cut.where("p is not null").select(*keys, "layer", "p.idx", "p.rate")
