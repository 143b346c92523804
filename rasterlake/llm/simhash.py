"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into max_bits + 1 segments on a ring. If two fingerprints differ in at most max_bits bits, some
segment starts a chain whose every prefix stays within its share of the budget: l segments in a row differ in at most
l * max_bits / (max_bits + 1) bits. Links are therefore looked for among fingerprints with an equal segment, pruned by
the longer chains, and then checked over all bits.

simhash_groups does so with one ring of 64 bits. Links by Jaccard similarity are looser: their candidates are found on many
short rings of a wide SimHash, in the same way, and are then confirmed on the whole sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, join_groups, marked, sieve, stored, table
from rasterlake.llm.graph import bucket_blocks, components, flat, forest

BLOCK = 512
#: Bits of a segment from which it is a key of its own.
SELECTIVE = 16
#: For links by Jaccard similarity: the least bits of a key, documents that should share one by chance, the share of the bits that
#: differ and the share of pairs to be found at a similarity of 0.8, and how many of 128 bits may differ.
LEAST_BITS, BY_CHANCE, FLIPPED, FOUND, CHECK_BITS = 13, 32, 0.15, 0.976, 28
#: For their rings: in how many bits candidates may differ on one, the share of pairs to be found at a similarity of 0.8, and by how
#: many bits the chains' keys are shorter than those of key_plan, as all prints of a bucket are compared at once.
RING_BITS, ON_RINGS, SHORTER = 2, 0.99, 5
#: Bytes of the sets in a block, at most about.
BLOCK_BYTES = 16 << 20


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of the text's shingles; of all its words if they are fewer than `words`."""
    # On bytes, lower() and split() take just A-Z and just the ASCII white space.
    w = (text or "").encode().lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's shingles, as a signed number; 0 if it has no word."""
    h = shingle_hashes(text, words, seed)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def segments(max_bits: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, bits) of max_bits + 1 segments of about the same size, on a ring of so many bits."""
    cuts = [bits * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chained(x: np.ndarray, start: int, max_bits: int, bits: int = 64) -> np.ndarray:
    """Whether in the differences x each chain from segment `start` on stays within its budget."""
    seg = segments(max_bits, bits)
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for length in range(1, len(seg) + 1):
        low, own = seg[(start + length - 1) % len(seg)]
        total += np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << own) - 1))
        ok &= total * len(seg) <= length * max_bits
    return ok


def links_of(start: int, left: np.ndarray, right: np.ndarray, max_bits: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that link between two blocks of a bucket, on a ring of their lowest bits: the shortest chains prune first."""
    near = near_masks(max_bits, bits)[start]
    x = left[:, None] ^ right[None, :]
    i, j = np.nonzero(np.bitwise_count(x & near) * (max_bits + 1) <= 2 * max_bits)
    x = x[i, j]
    ok = chained(x, start, max_bits, bits)
    ok &= np.bitwise_count(x & np.uint64((1 << bits) - 1)) <= max_bits
    return i[ok], j[ok]


def chain_keys(max_bits: int, bits: int = 64) -> list[Column]:
    """Structs (start, half, value): fingerprints that link have one of them in common.

    A chain begins with an equal segment. Where segments are short, a part of the next one is in the key too: a chain of
    two differs in at most one bit, so that one half of its second segment is equal as well.
    """
    part = lambda low, own: F.shiftrightunsigned("fp", low).bitwiseAND((1 << own) - 1)
    seg, out = segments(max_bits, bits), []
    for k, (low, own) in enumerate(seg):
        low2, bits2 = seg[(k + 1) % len(seg)]
        if own >= SELECTIVE:
            out.append(F.struct(F.lit(k).alias("start"), F.lit(0).alias("half"), part(low, own).alias("value")))
            continue
        cut = bits2 // 2
        for half, (l2, b2) in enumerate(((low2, cut), (low2 + cut, bits2 - cut))):
            out.append(F.struct(F.lit(k).alias("start"), F.lit(half).alias("half"), (part(low, own) * (1 << b2) + part(l2, b2)).alias("value")))
    return out


def near_masks(max_bits: int, bits: int = 64) -> np.ndarray:
    """For each start, the bits of its first two segments."""
    ones = np.array([((1 << own) - 1) << low for low, own in segments(max_bits, bits)], dtype=np.uint64)
    return ones | np.roll(ones, -1)


def links_within(start: np.ndarray, size: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that link in many buckets at once. Bucket i begins its chains at start[i] and is the next
    size[i] of the prints; each print is compared with those at 1, 2, ... places after it in its bucket."""
    parts = max_bits + 1
    start = np.repeat(start, size)
    near = near_masks(max_bits)[start]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(prints)) - 1
    at, k, found = np.flatnonzero(left >= 1), 1, [(np.zeros(0, dtype=np.int64),) * 2]
    while len(at):
        ok = np.bitwise_count((prints[at] ^ prints[at + k]) & near[at]) * parts <= 2 * max_bits
        found.append((at[ok], at[ok] + k))
        k += 1
        at = at[left[at] >= k]
    i, j = (np.concatenate([f[n] for f in found]) for n in (0, 1))
    x = prints[i] ^ prints[j]
    ok = np.zeros(len(x), dtype=bool)
    for s in range(parts):
        own = start[i] == s
        ok[own] = chained(x[own], s, max_bits)
    ok &= np.bitwise_count(x) <= max_bits
    return i[ok], j[ok]


def block_links(max_bits: int):
    """Spanning forests (a, b) of the links in the rows (start, left, right) of bucket_blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("start").to_numpy()
            alone = batch.column("right").is_null().to_numpy(zero_copy_only=False)
            left = batch.column("left")
            size = np.diff(left.offsets.to_numpy())
            prints = left.flatten().to_numpy().view(np.uint64)
            found = []
            own = np.repeat(alone, size)
            nodes = prints[own]
            found.append((nodes, *links_within(start[alone], size[alone], nodes, max_bits)))
            ends = np.cumsum(size)
            for row in np.flatnonzero(~alone):
                u, v = prints[ends[row] - size[row] : ends[row]], batch.column("right")[row].values.to_numpy().view(np.uint64)
                i, j = links_of(int(start[row]), u, v, max_bits)
                found.append((np.concatenate([u, v]), i, j + len(u)))
            a, b = [], []
            for nodes, i, j in found:
                root = forest(len(nodes), i, j)
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                a.append(nodes[moved].view(np.int64))
                b.append(nodes[root[moved]].view(np.int64))
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def simhash_groups(docs: DataFrame, max_bits: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for each row of docs; fp is the fingerprint as a signed long.

    component_id is the smallest id reachable over links of at most max_bits differing bits, the row's own included.
    Equal fingerprints are joined first, so copies cost one row; links between different fingerprints are found in
    blocks that return a spanning forest, never all pairs.

    - null, empty and blank texts: fingerprint 0, which links like any other; texts under `words` words: one shingle.
    - null ids: the row takes part, but gives no component its name; component_id is null if no id is reachable.
    - texts of any length are read whole, in slices of shingles. Columns named fp or component_id are no clash.
    - repeated rows each get their row, with the same result. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    prints = F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t, words)).astype("int64"), "long")
    own = Carried(docs, _id=id_col, _text=text_col).df
    fps = stored(own.select("_id", prints("_text").alias("fp")), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "representatives")
    # Each row becomes many: enough partitions for that, however few the fingerprints fill.
    spread = reps.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = spread.select("fp", F.explode(F.array(*chain_keys(max_bits))).alias("_s")).select("fp", "_s.*")
    blocks = bucket_blocks(parts, ["start", "half", "value"], "fp", BLOCK).select("start", "left", "right")
    links = blocks.mapInArrow(block_links(max_bits), "a long, b long")
    linked = components(links)
    roots = reps.join(linked, reps.fp == linked.node, "left").select("fp", "_rep", F.coalesce("component", "fp").alias("_root"), F.col("_n").alias("_rows"))
    roots = stored(roots, "roots")
    named = roots.groupBy("_root").agg(F.min("_rep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    known = join_groups(roots, named, ["_root"], reps.count()).select("fp", "component_id", F.col("_rows").alias("_n"))
    return join_groups(fps, known, ["fp"], fps.count()).select(F.col("_id").alias(id_col), "fp", "component_id")


def key_plan(docs: int) -> tuple[int, int]:
    """(keys, bits of each) for so many documents: keys long enough that about BY_CHANCE unlike documents share one, and as many
    as find FOUND of the pairs whose bits differ in FLIPPED of all places. Keys and their comparisons grow as the 0.23th
    power of the documents."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, docs / BY_CHANCE))))
    return math.ceil(math.log(1 - FOUND) / math.log1p(-((1 - FLIPPED) ** bits))), bits


def ring_plan(docs: int) -> tuple[int, int]:
    """(rings, bits of each) for so many documents: bits for keys of the chains, of one and a half segments, that are SHORTER than those of
    key_plan; and as many rings as find ON_RINGS of the pairs whose bits differ in FLIPPED of all places. Rings, and
    with them keys and comparisons of a document, grow as about the cube root of the documents."""
    bits = 2 * (RING_BITS + 1) * (key_plan(docs)[1] - SHORTER) // 3
    near = sum(math.comb(bits, k) * FLIPPED**k * (1 - FLIPPED) ** (bits - k) for k in range(RING_BITS + 1))
    return math.ceil(math.log(1 - ON_RINGS) / math.log1p(-near)), bits


def wide_print(h: np.ndarray, words: int = 8) -> np.ndarray:
    """64 * words bits of SimHash of a set of hashes, each of which is mixed anew for each 64 bits."""
    z = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(z), 255):  # as many as a byte counts
        ones += np.add.reduce(np.unpackbits(z[at : at + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return ones * 2 > len(h)


def shingle_sets(words: int, rings: int, width: int):
    """text -> node (a hash of its set of shingles), 64 bits of its wide print, and a print for each ring: the ring's own bits below, and
    above them bits that are the same for all rings, so that the two prints tell 128 bits apart."""

    @F.pandas_udf("node long, c long, rings array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        nodes, checks, prints = [], [], []
        for t in texts:
            h = np.unique(shingle_hashes(t, words))
            bits = wide_print(h, -(-(128 + rings * width) // 64))
            own = bits[128 : 128 + rings * width].reshape(rings, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
            c, above = np.packbits(bits[:128]).view("<u8")
            nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
            checks.append(c)
            prints.append((own | above >> np.uint64(width) << np.uint64(width)).view(np.int64))
        nodes, checks = (np.array(x, dtype=np.uint64).view(np.int64) for x in (nodes, checks))
        return pd.DataFrame({"node": nodes, "c": checks, "rings": prints})

    return run


def trees(found) -> pa.RecordBatch:
    """Spanning forests (a, b) of the links in found: (nodes, i, j) each."""
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for nodes, i, j in found:
        root = forest(len(nodes), i, j)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        a.append(nodes[moved])
        b.append(nodes[root[moved]])
    return pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def likely_links(width: int):
    """Forests of the pairs in the rows (start, left, right) that chains from segment `start` of a ring on link, and whose 128 bits
    differ in at most CHECK_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sides = batch.column("start").to_numpy(), []
            for name in ("left", "right"):
                at, items = flat(batch.column(name))
                node, *prints = (items.field(k).to_numpy() for k in ("node", "c", "fp"))
                sides.append((at, [node, *(x.view(np.uint64) for x in prints)]))
            found = []
            (la, left), (ra, right) = sides
            for row in range(batch.num_rows):
                u = [x[la[row] : la[row + 1]] for x in left]
                alone = ra[row] == ra[row + 1]
                v = u if alone else [x[ra[row] : ra[row + 1]] for x in right]
                for low in range(0, len(u[0]), 256):
                    first = low if alone else 0  # pairs within a block once
                    i, j = links_of(int(start[row]), u[2][low : low + 256], v[2][first:], RING_BITS, width)
                    i, j = i + low, j + first
                    near = np.bitwise_count(u[1][i] ^ v[1][j]) + np.bitwise_count(u[2][i] ^ v[2][j]) <= CHECK_BITS
                    if alone:
                        near &= i < j
                    if near.any():
                        found.append((u[0], i[near], j[near]) if alone else (np.concatenate([u[0], v[0]]), i[near], j[near] + len(u[0])))
            yield trees(found)

    return run


def likely_groups(prints: DataFrame, width: int) -> DataFrame:
    """(node, component) of the candidates among the rows (node, c, rings), one for each node: on some ring they differ in at most
    RING_BITS bits, and in at most CHECK_BITS of 128. All of them are found, by the chains of the rings; rows that link with none are left out."""
    rings = prints.select("node", "c", F.posexplode("rings").alias("ring", "fp"))
    members = rings.select("ring", F.struct("node", "c", "fp").alias("item"), F.explode(F.array(*chain_keys(RING_BITS, width))).alias("_s"))
    # One number for a bucket: its ring, the start of its chains, the half and the value.
    at = (F.col("ring") * (RING_BITS + 1) + F.col("_s.start")) * 2 + F.col("_s.half")
    members = members.select(F.shiftleft(at.cast("long"), 32).bitwiseOR(F.col("_s.value")).alias("key"), "item")
    start = F.pmod(F.shiftright("key", 33), F.lit(RING_BITS + 1)).cast("int").alias("start")
    return components(bucket_blocks(members, ["key"], "item", 4 * BLOCK).select(start, "left", "right").mapInArrow(likely_links(width), "a long, b long"))


def exact_links(least: float):
    """Forests of the pairs in the rows (left, right) whose sets have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                left, right = (batch.column(k)[row].values for k in ("left", "right"))
                items = left if right is None else pa.concat_arrays([left, right])
                nodes, sets = items.field("node").to_numpy(), [np.frombuffer(x.as_buffer(), dtype="<u8") for x in items.field("hashes")]
                size = np.array([len(x) for x in sets])
                codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
                at = np.concatenate([[0], np.cumsum(size)])
                has, i, j = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool), [], []
                for k in range(len(left)):
                    own, low = codes[at[k] : at[k + 1]], k + 1 if right is None else len(left)
                    has[own] = True
                    shared = np.diff(np.concatenate([[0], np.cumsum(has[codes[at[low] :]])])[at[low:] - at[low]])
                    near = low + np.flatnonzero((shared > 0) & (shared >= least * (size[k] + size[low:] - shared) - 1e-9))
                    has[own] = False
                    i.append(np.full(len(near), k))
                    j.append(near)
                found.append((nodes, np.concatenate(i), np.concatenate(j)))
            yield trees(found)

    return run


def one_of_each_group(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that a row of smaller id in their group stands for.

    Groups are what links of a Jaccard similarity of at least `least` between the sets of `words`-word shingles join.
    Every link is confirmed on the whole sets. Candidates are found by SimHash and pigeonring: documents that differ in at most
    RING_BITS bits on one of the rings of ring_plan, and in at most CHECK_BITS of 128 bits; the rings' chains lose none of them.
    Then all pairs of a group of candidates are checked, in blocks of bounded bytes. Of pairs at just 0.8 (15 % of the bits
    differ) about 99 % become candidates, above that more.

    - rows with a null id stay, and stand for none; null, empty and blank texts are copies of each other.
    - texts under `words` words: one shingle. Repeated rows, and copies that share an id, stay once.
    - texts of any length are read whole. All columns are kept, whatever their names; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    own = Carried(docs, id=id_col, text=text_col)
    rings, width = ring_plan(docs.count())
    coded = own.df.withColumn("h", F.xxhash64("text")).withColumn("s", shingle_sets(words, rings, width)("text"))
    # The rows' order and number hold from here on, as they are in the stored table.
    coded = stored(coded.select("row", "id", "h", "s.*"), "shingles")
    text = F.col(f"row.c{own.place(text_col)}")

    likely = stored(likely_groups(coded.select("node", "c", "rings").dropDuplicates(["node"]), width), "likely")

    hashes = F.pandas_udf(lambda s: s.map(lambda t: np.unique(shingle_hashes(t, words)).tobytes()), "binary")
    some = marked(coded, "node", *sieve(likely, "node")).where("_may")
    # One text of a node will do: all have the same set.
    one = some.select("node", hashes(text).alias("hashes")).dropDuplicates(["node"]).join(likely, "node")
    checked = stored(one.select("component", F.struct("node", "hashes").alias("item"), F.length("hashes").alias("bytes")), "sets")
    sure = components(bucket_blocks(checked, ["component"], "item", BLOCK // 4, "bytes", BLOCK_BYTES).select("left", "right").mapInArrow(exact_links(least), "a long, b long"))

    # Copies share a node: what follows joins a row for each node, and not the rows themselves, which may be mostly copies.
    stand = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("first")
    nodes = stored(coded.groupBy("node").agg(stand, F.count("id").alias("ids"), F.count(F.lit(1)).alias("rows")), "nodes")
    placed = stored(nodes.join(sure, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    groups = placed.groupBy("component").agg(F.min("first").alias("first"), F.sum("ids").alias("ids"), F.count(F.lit(1)).alias("_n")).where("ids > 1")
    fate = join_groups(placed.select("node", "component", "rows"), groups, ["component"], nodes.count())
    fate = stored(fate.select("node", "first", F.col("rows").alias("_n")), "groups")
    told = marked(coded, "node", *sieve(fate, "node"))
    alone = told.where("not _may")
    judged = join_groups(told.where("_may").drop("_may"), fate, ["node"], coded.count(), "left")
    free = judged.where(F.col("first").isNull() | F.col("id").isNull())
    firsts = judged.where((F.col("id") == F.col("first.id")) & (F.col("h").eqNullSafe(F.col("first.h")))).dropDuplicates(["id", "h"])
    return alone.select("row").unionByName(free.select("row")).unionByName(firsts.select("row")).select(*own.columns())


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
