"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming tables, and a rerank with the vectors.

Rotations are learned that make the signs of the rotated principal components balanced binary codes. A code is cut into
substrings of about log2(vectors) bits, one for each table, and an equi-join on them brings together codes that share one.
How many tables it takes is measured, on pairs at just the threshold, when the rotations are learned. Pairs whose codes are
near bring their vectors together in blocks, where cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.common import Carried, bounded_batches, join_groups, stored, table
from rasterlake.llm.graph import bucket_blocks, components, flat, forest

#: Vectors, and numbers in them, that the rotations are learned from, at most; every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 10_000, 4_000_000
#: Bits of one rotation, tables, rounds of learning: at most. Share of the pairs at the threshold that the tables must find.
BITS, TABLES, ROUNDS, RECALL = 128, 48, 20, 0.97
BLOCK = 1024


@dataclass(frozen=True)
class Hamming:
    """sign((unit vector - mean) @ turn) is a code of `tables` substrings of `width` bits; pairs are compared if some
    substrings are equal and the codes differ in at most `radius` bits, under the first table that they share."""

    mean: np.ndarray
    turn: np.ndarray
    tables: int
    width: int
    radius: int

    def labels(self, units: np.ndarray) -> np.ndarray:
        bits = (units - self.mean) @ self.turn > 0
        full = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
        full[:, : bits.shape[1]] = bits
        return np.packbits(full, axis=1, bitorder="little").view("<i8")

    def keys(self, labels: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(labels).view(np.uint8), axis=1, bitorder="little", count=self.tables * self.width)
        return bits.reshape(len(labels), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64)) + (np.arange(self.tables) << 32)

    def compared(self, key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(a, b): whether a pair of labels that meet under the key is to be compared there."""
        off = np.zeros((len(a), len(b)), dtype=np.uint16)
        for x, y in zip(a.T, b.T, strict=True):
            off += np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64))
        ok = off <= self.radius
        ka, kb = self.keys(a), self.keys(b)
        for earlier in range(key >> 32):
            ok &= ka[:, None, earlier] != kb[None, :, earlier]
        return ok


@dataclass(frozen=True)
class Cells:
    """The exact way. A vector's angles to some axes, in units of the largest angle that links, are cut into cells: by the
    triangle inequality the vectors of a link are in the same cell or the next on every axis. Pairs meet under the cell
    that is the larger of theirs on every axis. How much this prunes depends on how the vectors spread over the axes."""

    axes: np.ndarray
    angle: float

    def labels(self, units: np.ndarray) -> np.ndarray:
        return np.floor(np.arccos(np.clip(units @ self.axes, -1, 1)) / self.angle).astype(np.int64)

    def keys(self, labels: np.ndarray) -> np.ndarray:
        n = labels.shape[1]
        steps = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        return (labels[:, None, :] + steps[None]) @ self.places(n)

    def compared(self, key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones((len(a), len(b)), dtype=bool)
        for x, y, place in zip(a.T, b.T, self.places(a.shape[1]), strict=True):
            ok &= np.maximum(x[:, None], y[None, :]) == key // place % (1 << 20)
        return ok

    @staticmethod
    def places(n: int) -> np.ndarray:
        return 1 << 20 * np.arange(n, dtype=np.int64)


def units_of(offsets: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, lengths); shorter ones end in zeros, which leaves cosines as they are."""
    dims = np.diff(offsets)
    out = np.zeros((len(dims), size))
    out[np.arange(size)[None, :] < dims[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def rotation(v: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Alternates between the codes nearest to the rotated rows and the rotation nearest to the codes."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return turn


def partners(units: np.ndarray, threshold: float, seed: int = 1) -> np.ndarray:
    """For each unit vector one at just the threshold: half of them away in any direction, half towards another vector."""
    random = np.random.default_rng(seed)
    away = random.standard_normal(units.shape)
    away[::2] = units[random.permutation(len(units))][::2] - units.mean(axis=0) + 1e-9 * away[::2]
    away -= (away * units).sum(axis=1, keepdims=True) * units
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    return threshold * units + math.sqrt(1 - threshold**2) * away / np.where(norm > 0, norm, 1)


def learn(units: np.ndarray, threshold: float, vectors: int) -> Hamming | Cells:
    """Rotations and tables for `vectors` vectors such as these. Substrings are of log2(vectors) bits, and shorter only if
    TABLES tables of that length would find less than RECALL of the pairs at the threshold; cells if no length would do."""
    known, new = (units[::2], units[1::2]) if len(units) > 100 else (units, units)  # it is measured on vectors it has not seen
    mean = known.mean(axis=0)
    _, axes = np.linalg.eigh((known - mean).T @ (known - mean))
    axes = axes[:, ::-1][:, : min(BITS, units.shape[1])]
    u, v, other = (known - mean) @ axes, (new - mean) @ axes, (partners(new, threshold) - mean) @ axes
    turns, flips = [], np.zeros((len(v), 0), dtype=bool)
    kinds = [np.arange(len(v)) % 2 == k for k in range(min(2, len(v)))]
    for width in range(max(4, min(30, math.ceil(math.log2(max(2, vectors))))), 0, -1):
        missed = np.ones(len(v), dtype=bool)
        for tables in range(1, TABLES + 1):
            while flips.shape[1] < tables * width:
                turns.append(rotation(u, len(turns)))
                flips = np.hstack([flips, (v @ turns[-1] > 0) != (other @ turns[-1] > 0)])
            missed &= flips[:, (tables - 1) * width : tables * width].any(axis=1)
            if max(missed[k].mean() for k in kinds) <= 1 - RECALL:
                bits = tables * width
                return Hamming(mean, (axes @ np.hstack(turns))[:, :bits], tables, width, int(flips[:, :bits].sum(axis=1).max()) + 2)
    return cells(units, threshold)


def cells(units: np.ndarray, threshold: float) -> Cells:
    """Cells by the direction of the mean and the two principal axes."""
    mean = units.mean(axis=0)
    _, axes = np.linalg.eigh((units - mean).T @ (units - mean))
    axes = np.hstack([mean[:, None] if np.linalg.norm(mean) > 1e-9 else axes[:, :1], axes[:, ::-1][:, :2]])
    return Cells(axes / np.linalg.norm(axes, axis=0), max(math.acos(min(1.0, threshold)) * (1 + 1e-9), 1e-5) + 1e-7)


def list_rows(items: pa.Array, name: str, width: int) -> np.ndarray:
    return items.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def likely_members(finder: Hamming | Cells, width: int):
    """The items of the rows (key, p, q, left, right) that are to be compared with another of the row: key, p, q, side, g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (la, left), (ra, right) = (flat(batch.column(k)) for k in ("left", "right"))
            lg, rg, ll, rl = left.field("g").to_numpy(), right.field("g").to_numpy(), list_rows(left, "label", width), list_rows(right, "label", width)
            out = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
            for row, key in enumerate(batch.column("key").to_numpy()):
                u, v = slice(la[row], la[row + 1]), slice(ra[row], ra[row + 1])
                alone = v.start == v.stop
                ok = finder.compared(int(key), ll[u], ll[u] if alone else rl[v])
                if alone:
                    ok = np.triu(ok, 1)
                    sides = [(0, lg[u][ok.any(axis=0) | ok.any(axis=1)])]
                else:
                    sides = [(0, lg[u][ok.any(axis=1)]), (1, rg[v][ok.any(axis=0)])]
                for side, g in sides:
                    for part, values in zip(out, (np.full(len(g), row), np.full(len(g), side), g), strict=True):
                        part.append(values)
            row, side, g = map(np.concatenate, out)
            yield pa.RecordBatch.from_pydict({**{k: batch.column(k).take(pa.array(row)) for k in ("key", "p", "q")}, "side": side.astype(np.int32), "g": g})

    return run


def vector_links(finder: Hamming | Cells, width: int, threshold: float, size: int):
    """For the members (side, g, n, label, v) of a row: how many rows of the others each links with, and its forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = flat(batch.column("m"))
            side, g, n = (items.field(k).to_numpy() for k in ("side", "g", "n"))
            label, v = list_rows(items, "label", width), items.field("v")
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            values, out = v.flatten().to_numpy(zero_copy_only=False), [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
            for row, key in enumerate(batch.column("key").to_numpy()):
                own = np.arange(at[row], at[row + 1])
                own = own[np.argsort(side[own], kind="stable")]
                low = at[row]
                units, dims = units_of(ends[low : at[row + 1] + 1], values[ends[low] : ends[at[row + 1]]], size)
                units, dims, alone = units[own - low], dims[own - low], batch.column("p")[row] == batch.column("q")[row]
                half = len(own) if alone else int((side[own] == 0).sum())
                i, j = slice(half), slice(half) if alone else slice(half, None)
                near = (units[i] @ units[j].T >= threshold) & (dims[i, None] == dims[None, j]) & finder.compared(int(key), label[own[i]], label[own[j]])
                links = np.zeros(len(own), dtype=np.int64)
                if alone:
                    np.fill_diagonal(near, False)
                    links[i] = near @ n[own[j]]
                else:
                    links[i], links[j] = near @ n[own[j]], near.T @ n[own[i]]
                x, y = np.nonzero(near)
                root = forest(len(own), x, y if alone else y + half)
                has = links > 0
                for part, found in zip(out, (g[own][has], links[has], g[own][root[has]]), strict=True):
                    part.append(found)
            yield pa.RecordBatch.from_pydict(dict(zip(("g", "links", "root"), map(np.concatenate, out), strict=True)))

    return run


def learned(copies: DataFrame, threshold: float, exact: bool) -> tuple[Hamming | Cells | None, int]:
    """(what finds the pairs, components of the longest vector), from a sample of the different vectors v."""
    vectors, size = copies.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not vectors:
        return None, 1
    most = max(2, min(SAMPLE, SAMPLE_NUMBERS // size))
    sample = copies.orderBy("g").select(F.col("v").cast("array<double>").alias("v")).limit(most).toArrow()["v"].combine_chunks()
    units, _ = units_of(np.concatenate([[0], np.cumsum(sample.value_lengths().to_numpy())]), sample.flatten().to_numpy(), size)
    return (cells(units, threshold) if exact else learn(units, threshold, vectors)), size


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each distinct row (id, vector).

    n_links counts the other vectors with a cosine of at least threshold; component_id is the smallest id reachable.
    None below the threshold is ever given. The tables are sized to find RECALL of the links at just the threshold, and
    more of those above it; with exact=True all links are found, by cells of angles, at up to the square of the vectors.
    Equal vectors are one entry with a count.

    - vectors that are null, empty, zero or hold null or non-finite components: no links, a component of their own.
    - vectors of different lengths never link. Null ids: the row links and counts, but names no component.
    - repeated rows (same id, same vector) are one vector. Other columns are not read, whatever their names. An empty
      table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    v = F.col("_v")
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = Carried(vectors, _id=id_col, _v=vector_col).df.select("_id", "_v")
    if rows.schema["_v"].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        rows = rows.withColumn("_v", v.cast("array<double>"))
    rows = rows.withColumn("_sound", sound).withColumns({"_h1": F.xxhash64("_v"), "_h2": F.xxhash64(F.lit(1), "_v")})
    rows = stored(rows.dropDuplicates(["_id", "_h1", "_h2"]), "vectors")
    copies = rows.where("_sound").groupBy("_h1", "_h2").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("n"), F.first("_v").alias("v"))
    copies = stored(copies.withColumn("g", F.xxhash64("_h1", "_h2")), "copies")
    finder, size = learned(copies, threshold, exact)

    @F.pandas_udf("label array<bigint>, keys array<bigint>")
    def placed(s: pd.Series) -> pd.DataFrame:
        units, _ = units_of(np.concatenate([[0], np.cumsum([len(x) for x in s])]), np.concatenate([np.zeros(0), *s]), size)
        labels = finder.labels(units) if finder else np.zeros((len(s), 1), dtype=np.int64)
        return pd.DataFrame({"label": list(labels), "keys": list(finder.keys(labels)) if finder else [[]] * len(s)})

    coded = stored(copies.withColumn("_p", placed("v")).select(*copies.columns, "_p.label", "_p.keys"), "codes")
    width = finder.labels(np.zeros((1, size))).shape[1] if finder else 1
    members = coded.select(F.explode("keys").alias("key"), F.struct("g", "label").alias("item"))
    blocks = bucket_blocks(members, ["key"], "item", BLOCK)
    likely = blocks.mapInArrow(likely_members(finder, width), "key long, p int, q int, side int, g long")
    pairs = likely.join(coded.select("g", "n", "label", "v"), "g").groupBy("key", "p", "q").agg(F.collect_list(F.struct("side", "g", "n", "label", "v")).alias("m"))
    found = stored(pairs.mapInArrow(vector_links(finder, width, threshold, size), "g long, links long, root long"), "links")

    linked = components(found.select(F.col("g").alias("a"), F.col("root").alias("b")))
    groups = coded.select("_h1", "_h2", "g", "n", "_rep").join(found.groupBy("g").agg(F.sum("links").alias("links")), "g", "left").join(linked, F.col("g") == F.col("node"), "left")
    groups = stored(groups.select("_h1", "_h2", "_rep", F.coalesce("component", "g").alias("_root"), F.col("n").alias("_rows"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links")), "groups")
    names = groups.groupBy("_root").agg(F.min("_rep").alias("_name"), F.count(F.lit(1)).alias("_n"))
    named = join_groups(groups, names, ["_root"], groups.count()).select("_h1", "_h2", F.col("_rows").alias("_n"), "_links", "_name")
    bad = rows.where("not _sound").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_name"))
    sure = rows.where("_sound").select("_id", "_h1", "_h2")
    good = join_groups(sure, named, ["_h1", "_h2"], sure.count()).select("_id", "_links", "_name")
    out = good.unionByName(bad)
    return out.select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_name").alias("component_id"), F.coalesce(F.col("_id") == F.col("_name"), F.lit(False)).alias("kept"))


def op8_itq_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
