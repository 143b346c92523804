"""Periodic runs of words: stretches that repeat a few words over and over, and texts without the repeats.

Karp, Miller and Rosenberg's naming gives stretches of 1, 2, 4, ... words one name if they are equal; names are made by sorting
pairs of names, for a whole batch of texts at once, and only for stretches that could still be equal to another. How far two
places agree is read off by descending levels. Runs of period q are sought on the grid of multiples of q, where the stretches
at a place and at q words on have the same name, and extended both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, let, table

#: A run has at least so many words, and at least so many times its period.
WORDS, POWER = 6, 4
#: Pairs of places that are looked at together, at most.
PAIRS = 1 << 20
WHITE = r"[\x20\x09-\x0D]+"


def repeated(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the places `at` by their keys: equal and not negative for equal keys. Places whose key no other place has,
    and all others, have a negative name of their own."""
    out = -1 - np.arange(size, dtype=np.int32)
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[name] > 1
    out[at[again]] = name[again]
    return out


def naming(words: np.ndarray) -> list[np.ndarray]:
    """Level k names the stretch of 2**k words at each place; words below zero are like no other. The last level is the last
    one that has two equal stretches."""
    at = np.flatnonzero(words >= 0)
    levels = [repeated(words[at], at, len(words))]
    while True:
        names, step = levels[-1], 1 << len(levels) - 1
        at = np.flatnonzero(names[: max(0, len(names) - step)] >= 0)
        at = at[names[at + step] >= 0]
        if not len(at):
            return levels
        longer = repeated(names[at].astype(np.int64) << 32 | names[at + step], at, len(names))
        if longer.max() < 0:
            return levels
        levels.append(longer)


def agreement(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places i on are equal to those from places j > i on; with back, how many before them."""
    i, j, out, size = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64), len(levels[0])
    for k in reversed(range(len(levels))):
        step = 1 << k
        ok = i >= step if back else j < size
        a, b = (i - step, j - step) if back else (i, j)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        move = np.where(ok, step, 0)
        out += move
        i, j = (i - move, j - move) if back else (i + move, j + move)
    return out


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs, by start, then period.

    In a run, at least (POWER - 1) q words are equal to those q on, so that one of the grid's places is followed by 2 q of
    them, and all the more by 2**k, the largest power of two up to 2 q. That is over q: neighbouring places of the grid
    that have equal names are in one run, and the first is extended.
    """
    levels, size, found = naming(words), len(words), [np.zeros((3, 0), dtype=np.int64)]
    for k in range(1, len(levels)):
        q = np.arange(1 << k - 1, min(1 << k, size // POWER + 1), dtype=np.int64)
        while len(q):
            places = np.cumsum((size - 1) // q)
            some = max(1, int(np.searchsorted(places, PAIRS)))
            period = np.repeat(q[:some], np.diff(places[:some], prepend=0))
            step = np.arange(len(period)) - np.repeat(np.concatenate([[0], places[: some - 1]]), np.diff(places[:some], prepend=0))
            at = step * period
            same = levels[k][at] == levels[k][at + period]
            first = same & ~(np.concatenate([[False], same[:-1]]) & (step > 0))
            at, period, q = at[first], period[first], q[some:]
            ahead, before = agreement(levels, at, at + period), agreement(levels, at, at + period, back=True)
            length = ahead + before + period
            long = length >= np.maximum(WORDS, POWER * period)
            found.append(np.stack([at - before, length, period])[:, long])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))  # a stretch found under multiples of its period, too
    start, length, period = start[order], length[order], period[order]
    keep = np.ones(len(start), dtype=bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def batch_runs(texts: pa.Array) -> pa.Array:
    """A struct (runs, collapsed) for each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts.to_pylist()]  # bytes.split parts words at just the white space that is meant
    ends = np.cumsum([len(w) + 1 for w in words])  # after each text's words a place that is like no other
    known: dict[bytes, int] = {}
    flat = np.full(ends[-1] if len(ends) else 0, -1, dtype=np.int64)
    for own, end in zip(words, ends, strict=True):
        flat[end - 1 - len(own) : end - 1] = np.fromiter((known.setdefault(w, len(known)) for w in own), dtype=np.int64, count=len(own))
    start, length, period = runs_of(flat)
    text = np.searchsorted(ends, start, side="right")
    change = np.bincount(start + period, minlength=len(flat) + 1) - np.bincount(start + length, minlength=len(flat) + 1)
    gone = np.cumsum(change) > 0
    collapsed = []
    for own, end in zip(words, ends, strict=True):
        out = gone[end - 1 - len(own) : end - 1]
        collapsed.append(b" ".join([w for w, x in zip(own, out.tolist(), strict=True) if not x] if out.any() else own))
    first = np.concatenate([[0], ends[:-1]])[text] if len(ends) else start
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first, length, period)], ["start", "length", "period"])
    offsets = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string())], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with runs, an array of (start, length, period) by start, then period, and collapsed, the text without repeats.

    Words are parted by ASCII white space and numbered from 0. A run is a stretch of at least WORDS words, and POWER times its
    smallest period, in which words a period apart are equal, and which no neighbouring word extends. collapsed has the words
    that no run holds after its first period, joined by single spaces.

    - null, empty and blank texts: no runs, and collapsed is ''.
    - texts of any length are read whole; a batch takes about 4 bytes a word and level while it is worked on, and has as many
      levels as the logarithm of its longest repeated stretch.
    - repeated rows get the same result each; an empty table stays empty.
    - columns of docs that are named runs or collapsed, in any case, are replaced; others pass through.
    """
    bounded_batches(docs.sparkSession)
    run = F.arrow_udf(lambda texts: batch_runs(texts), "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    own = Carried(docs, _text=text_col)
    found = own.df.select("row", run("_text").alias("_found"))
    return found.select(*own.columns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}))


def greatest(runs: Column) -> Column:
    """The run of the greatest length for its period, by exact fractions; the first one of ties. Null without runs."""
    ahead = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(ahead(best, x), x).otherwise(best))


def with_repeats(text: Column, id_col: Column) -> Column:
    """The text, or for one document in ten, by its id's hash, one whose words repeat from some word on. Null ids: the text."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.lit("")))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    best = greatest(F.col("runs"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
