"""Vector codes: parts of integer vectors as indexes into codebooks, which rounds of nearest entries and floored means make.

Each round broadcasts a kd-tree for each codebook. Batches find the nearest entries by branch and bound, in exact integers,
and each task gives its sums of parts by entry; Spark adds them up, and the driver sees one sum for each place of an entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, join_groups, stored, table

#: Parts of a vector, entries of a codebook, rounds of learning, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf of the tree, at most.
LEAF = 2


@dataclass(frozen=True)
class Tree:
    """The entries of a codebook, halved at the median of the widest side until LEAF are left. Each node has the box that
    holds its entries; order[start:stop] are their indexes."""

    entries: np.ndarray
    order: np.ndarray
    nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]]  # low and high corner, start, stop, children (0: none)

    @staticmethod
    def of(entries: np.ndarray) -> Tree:
        order, nodes = np.arange(len(entries)), []

        def grow(start: int, stop: int) -> int:
            held = entries[order[start:stop]]
            low, high = held.min(axis=0), held.max(axis=0)
            at = len(nodes)
            nodes.append((low, high, start, stop, 0, 0))
            if stop - start > LEAF and (high > low).any():
                side, half = int((high - low).argmax()), (start + stop) // 2
                order[start:stop] = order[start:stop][np.argsort(held[:, side], kind="stable")]
                nodes[at] = (low, high, start, stop, grow(start, half), grow(half, stop))
            return at

        grow(0, len(entries))
        return Tree(entries, order, nodes)

    def bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """What the squared distance to any entry of the node is at least."""
        low, high, *_ = self.nodes[node]
        off = np.maximum(np.maximum(low - x, x - high), 0)
        return (off * off).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; of entries at one distance the lowest index.

        Rows go down to the leaf that seems nearest, then into every node whose bound is at most the best distance so far: a
        node of just that bound may hold an entry as near, of a lower index.
        """
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def compare(node: int, rows: np.ndarray) -> None:
            for e in self.order[slice(*self.nodes[node][2:4])]:
                off = x[rows] - self.entries[e]
                d = (off * off).sum(axis=1)
                nearer = rows[(d < best[rows]) | ((d == best[rows]) & (e < index[rows]))]
                best[nearer], index[nearer] = ((x[nearer] - self.entries[e]) ** 2).sum(axis=1), e

        def descend(node: int, rows: np.ndarray) -> None:
            left, right = self.nodes[node][4:]
            if not left:
                compare(node, rows)
            elif len(rows):
                first = self.bound(left, x[rows]) <= self.bound(right, x[rows])
                descend(left, rows[first])
                descend(right, rows[~first])

        def visit(node: int, rows: np.ndarray) -> None:
            rows = rows[self.bound(node, x[rows]) <= best[rows]]
            left, right = self.nodes[node][4:]
            if len(rows) and left:
                visit(left, rows)
                visit(right, rows)
            elif len(rows):
                compare(node, rows)

        descend(0, np.arange(len(x)))
        visit(0, np.arange(len(x)))
        return index, best


def largest(size: int) -> int:
    """Components of up to this much, either way, keep the squared distances of vectors of that size within a long."""
    return math.isqrt(((1 << 63) - 1) // size) // 2


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(kept rows of Carried(vectors) with `_id` and `_v`, integer components; components of each, a multiple of PARTS)."""
    own = Carried(vectors, _id=id_col, _vector=vector_col).df
    v = F.col("_vector")
    scaled = F.transform(v, lambda x: x.cast("double") * SCALE)
    own = own.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    own = own.withColumn("_scaled", scaled)
    first = own.orderBy(F.col("_id").asc_nulls_last(), "_scaled").select(F.size("_scaled")).first()
    size = first[0] if first else PARTS
    most = float(largest(size))
    own = own.where((F.size("_scaled") == size) & ~F.exists("_scaled", lambda x: F.abs(x) > most))
    return own.select("row", "_id", F.transform("_scaled", lambda x: F.floor(x).cast("long")).alias("_v")), size


def parts_of(column: pa.Array, size: int) -> np.ndarray:
    """(part, vector, place)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(-1, PARTS, size // PARTS).transpose(1, 0, 2)


def entry_sums(trees, size: int):
    """Each task's sums (part, entry, place, total, n) of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees.value
        entries, width = len(books[0].entries), size // PARTS
        total, n = np.zeros((PARTS, entries, width), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)
        for batch in batches:
            for k, part in enumerate(parts_of(batch.column("_v"), size)):
                index, _ = books[k].nearest(part)
                np.add.at(total[k], index, part)
                n[k] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(n)
        each = np.repeat(np.arange(len(part)), width)
        place = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_pydict({"part": part[each], "entry": entry[each], "place": place, "total": total[part, entry].ravel(), "n": n[part, entry][each]})

    return run


def learn_codebooks(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks (part, entry, place) of integers.

    They start as the parts of the rows with the smallest ids (ties: the smaller vector), in that order. Each round finds
    every part's nearest entry (ties: the lower index), and makes each entry the floored mean of its parts, place by place;
    an entry without parts stays.

    - vectors are left out if they are null, empty, not of a multiple of PARTS components, hold null or non-finite components
      or such as would carry distances beyond a long (see largest), or differ in size from the one of the smallest id.
    - null ids come last; repeated rows count each; fewer rows than entries make that many entries, none an empty array.
    - other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, size = integers(vectors, id_col, vector_col)
    rows = stored(rows.select("_id", "_v"), "integers")
    first = [r["_v"] for r in rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()]
    books = np.array(first, dtype=np.int64).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        trees = spark.sparkContext.broadcast([Tree.of(b) for b in books])
        sums = rows.select("_v").mapInArrow(entry_sums(trees, size), "part long, entry long, place long, total long, n long")
        means = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in means.collect():  # a row for each number of the codebooks
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        trees.destroy()
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors with code (the indexes of the nearest entries, two hex digits each, in the order of the parts) and error (the
    squared distances, summed over the parts).

    Which rows are left out is told at learn_codebooks; so are those of another size than the codebooks'. Columns of vectors
    that are named code or error, in any case, are replaced; others pass through, whatever their names.
    """
    bounded_batches(vectors.sparkSession)
    own = Carried(vectors)
    rows, size = integers(vectors, id_col, vector_col)
    fits = books.shape[1] > 0 and size == books.shape[0] * books.shape[2]
    trees = vectors.sparkSession.sparkContext.broadcast([Tree.of(b) for b in books] if fits else [])
    kind = "struct<code: string, error: bigint>"

    @F.arrow_udf(kind)
    def run(v: pa.Array) -> pa.Array:
        found = [tree.nearest(part) for tree, part in zip(trees.value, parts_of(v, size), strict=True)]
        index, error = np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)
        code = [row.tobytes().hex() for row in index.astype(np.uint8)]
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(error, pa.int64())], ["code", "error"])

    found = rows.withColumn("_found", run("_v")) if fits else rows.where("false").withColumn("_found", F.lit(None).cast(kind))
    return found.select(*own.columns({"code": F.col("_found.code"), "error": F.col("_found.error")}))


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector that a code stands for, in doubles."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    index = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda k: parts[k][F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int")])
    return F.transform(F.flatten(index), lambda x: x / F.lit(float(SCALE)))


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: the errors of all rows of its label together, null labels being one; null beyond a long."""
    own = Carried(coded, _label=label_col, _error="error")
    keys = {"_none": F.col("_label").isNull(), "_name": F.coalesce(F.col("_label").cast("string"), F.lit(""))}
    rows = own.df.withColumns(keys)
    total = F.sum(F.col("_error").cast("decimal(38,0)")).try_cast("long")
    sums = rows.groupBy("_none", "_name").agg(F.count(F.lit(1)).alias("_n"), total.alias("_total"))
    return join_groups(rows, sums, ["_none", "_name"], coded.count()).select(*own.columns({"label_error": F.col("_total")}))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = learn_codebooks(vectors)
    digest = ",".join(str(x) for x in books.ravel().tolist())
    coded = stored(encode(vectors, books).select("vec_id", "label", "code", "error"), "codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.sha2(F.lit(digest), 256).alias("codebooks_sha256"))


def oracle(width: int = 8) -> str:
    """SQL for vectors of PARTS * width components."""
    places = range(1, width + 1)
    key = " + ".join(f"(p.v[{i}] - e.v[{i}]) * (p.v[{i}] - e.v[{i}])" for i in places)
    nearest = f"SELECT p.vec_id, p.part, min(({key}) * {ENTRIES} + e.entry) AS m FROM p JOIN e{{0}} e ON p.part = e.part GROUP BY p.vec_id, p.part"
    floors = ", ".join(f"((sum(p.v[{i}]) - (sum(p.v[{i}]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT" for i in places)
    sql = [
        f"""g AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT for x in embedding] AS v FROM embeddings
WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, k AS part, v[k * {width} + 1 : k * {width} + {width}] AS v FROM g, range({PARTS}) AS r(k))",
        f"f AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM g ORDER BY vec_id LIMIT {ENTRIES})",
        "e0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (vec_id))",
    ]
    for k in range(ROUNDS):
        sql.append(f"a{k} AS MATERIALIZED ({nearest.format(k)})")
        sql.append(f"u{k} AS MATERIALIZED (SELECT p.part, a.m % {ENTRIES} AS entry, [{floors}] AS v FROM p JOIN a{k} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY p.part, a.m % {ENTRIES})")
        sql.append(f"e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(u.v, e.v) AS v FROM e{k} e LEFT JOIN u{k} u ON e.part = u.part AND e.entry = u.entry)")
    sql.append(f"a{ROUNDS} AS MATERIALIZED ({nearest.format(ROUNDS)})")
    sql.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    sql.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{ROUNDS})")
    return "WITH " + ",\n".join(sql) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN g USING (vec_id), h"


ORACLE_SQL = oracle()
