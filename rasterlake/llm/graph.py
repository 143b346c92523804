"""Linking within buckets of any size, and connected components, both without listing all pairs of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import join_groups, stored


def bucket_blocks(members: DataFrame, keys: list[str], item: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Rows (*keys, p, q, left, right): every two items of a bucket meet in just one row, as members of left and right,
    which are its blocks p and q.

    right is null where left is compared with itself. A bucket of up to `size` items is one row; a larger one is
    dealt by hash into blocks of about `size`, and each two blocks make a row. Items of a hot bucket are dealt where
    they are, before any shuffle (see join_groups), so no task gets a whole large bucket.
    members must not repeat an item within a bucket; it is read twice. Buckets of one item are left out. If items differ in
    weight, a column of that name tells it, and blocks are of about `most` at most.
    """
    heavy = [F.sum(weight).alias("_w")] if weight else []
    counts = stored(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *heavy).where("_n > 1"), "buckets")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    parts = F.ceil(F.col("_n") / F.lit(size))
    if weight:
        parts = F.greatest(parts, F.least(F.ceil(F.col("_w") / F.lit(most)), F.col("_n")))
    sizes = counts.withColumn("_parts", parts.cast("int")).drop("_w")
    dealt = join_groups(members, sizes, keys, total).withColumn("_part", F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("_parts")).cast("int"))
    block = dealt.groupBy(*keys, "_part").agg(F.collect_list(item).alias("left"), F.first("_parts").alias("_parts"))
    kind = block.schema["left"].dataType
    alone = block.select(*keys, F.col("_part").alias("p"), F.col("_part").alias("q"), "left", F.lit(None).cast(kind).alias("right"))
    large = block.where("_parts > 1")
    ahead = large.where(F.col("_part") < F.col("_parts") - 1).select(*keys, F.col("_part").alias("p"), "left", F.explode(F.sequence(F.col("_part") + 1, F.col("_parts") - 1)).alias("_part"))
    across = ahead.join(large.select(*keys, "_part", F.col("left").alias("right")), [*keys, "_part"]).select(*keys, "p", F.col("_part").alias("q"), "left", "right")
    return alone.unionByName(across)


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(where each row's items begin, and the end; the items) of a column of lists, null rows being empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]), column.flatten()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (a[i], b[i])."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): for each node of the links (a, b), the smallest node it reaches.

    Alternates between linking every node's larger neighbours, then its smaller ones, to its smallest neighbour,
    until the links no longer change; this takes about log(longest path) rounds of aggregates and joins. A node that
    holds a large share of all links, as the first of a large component does, is joined by broadcast (see join_groups).
    Each round is written to the shared checkpoint folder. Nulls and self-links are left out; repeated links count once.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    down = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = measure(down)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_groups(both, smallest(both), ["a"], 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        large = stored(large, "links")
        near = smallest(large)
        small = join_groups(large, near, ["a"], large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        down = stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        now = measure(down)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
