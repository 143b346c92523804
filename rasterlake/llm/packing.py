"""Packing in space-filling-curve order.

A document's token counts are hashed into a vector, projected to a few dimensions, and placed on a Hilbert curve.
Documents are range-sorted by their place on the curve and laid end to end; the row of tokens is cut into sequences, so
that a sequence holds neighbours, and only the last one is not full.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, stored, table
from rasterlake.llm.tokens import END, coder, ids_of

LENGTH, BUCKETS, DIMS, BITS = 1024, 512, 3, 10


def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = 4) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def document_point(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The projection of the unit vector of the hashed counts' square roots; the origin for no ids."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(len(plane))))
    v = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=len(plane)))
    return v @ plane / max(1.0, float(np.linalg.norm(v)))


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) below 2**bits, by rotating and reflecting the cube that
    holds a point, bit by bit."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def on_curve(points: np.ndarray) -> np.ndarray:
    """Keys of projected unit vectors, each coordinate spread by the normal distribution function."""
    even = np.vectorize(math.erf, otypes=[float])(points / math.sqrt(2)) / 2 + 0.5
    return hilbert_key(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def encoded(path: str):
    """text -> ids (with the end id), n, key on the curve, and a checksum that orders documents of one place."""

    @F.pandas_udf("ids binary, n long, key long, h long")
    def run(texts: pd.Series) -> pd.DataFrame:
        plane, code, end = projection(), coder(path), np.uint16(END).tobytes()
        ids = [code.whole(t) for t in texts]
        points = np.array([document_point(ids_of(x), plane) for x in ids]).reshape(-1, DIMS)
        return pd.DataFrame({"ids": [x + end for x in ids], "n": [len(x) // 2 + 1 for x in ids], "key": on_curve(points), "h": [zlib.crc32(x) for x in ids]})

    return run


def cut(length: int):
    """A document's pieces, one for each sequence that its tokens fall into."""
    kind = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint,ids:binary>>"

    @F.pandas_udf(kind)
    def run(packed: pd.Series, firsts: pd.Series) -> pd.Series:
        out = []
        for x, first in zip(packed, firsts, strict=True):
            ids = ids_of(x).astype("<u4")
            cuts = [0, *range(length - first % length, len(ids), length), len(ids)]
            out.append([{"start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes()), "sequence_id": (first + a) // length, "offset": (first + a) % length, "ids": x[2 * a : 2 * b]} for a, b in zip(cuts, cuts[1:], strict=False)])
        return pd.Series(out)

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    (little-endian 16-bit). Sequences are numbered from 0 along the curve; every one but the last is full.

    - null text: empty; an empty text is its end id alone. Documents longer than a sequence are cut as any other.
    - null ids sort first among equal places and pass through; repeated rows are packed once each.
    - ties on the curve (copies) are ordered by id, then by a checksum of their ids. An empty table gives no rows.
    - columns of docs other than id_col and text_col are not read, whatever their names.

    Only row numbers, token counts and curve keys are range-sorted. A range of any number of equal keys is split, as ids are
    sorted with them. Where a document starts is a running sum in its range and a sum over the ranges before.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = Carried(docs, id=id_col, text=text_col).df
    rows = own.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("text", F.lit("")).alias("text"))
    # The row numbers hold from here on, as they are in the stored table.
    coded = stored(rows.withColumn("coded", encoded(path)("text")).select("row", "id", "coded.*"), "tokens")

    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "id", "h", "row"]
    placed = stored(coded.select(*order, "n").repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "places")
    total = placed.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = total.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    firsts = placed.withColumn("own", own).join(F.broadcast(before), "part").select("row", (F.col("own") + F.col("before")).alias("first"))
    pieces = coded.select("row", "id", "ids", "n").join(firsts, "row").select("id", "ids", "n", "first")
    return pieces.select(F.col("id").alias(id_col), F.col("n").alias("doc_tokens"), F.inline(cut(length)("ids", "first")))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
