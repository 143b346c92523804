"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three letters, words padded with a space) in the order
of their counts. A text's own order is compared with each profile by the out-of-place distance: how far each of its
n-grams is from its place in the profile, or the profile's length where it has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, table

PLACES = 300
SLICE = 1 << 20
UNKNOWN = "und"
#: A character that is no letter: no n-gram goes on over it.
NO_LETTER = re.compile(r"[\W\d_]")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(indices, parts) of about SLICE characters each. A longer text is cut where a word ends; one word is never cut."""
    at, parts, total = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > SLICE:
                gap = NO_LETTER.search(text, start + SLICE)
                end = gap.start() if gap else end
            at.append(i)
            parts.append(text[start:end])
            total += end - start
            if total >= SLICE:
                yield np.array(at), parts
                at, parts, total = [], [], 0
            if end == len(text):
                break
            start = end
    if parts:
        yield np.array(at), parts


def part_grams(group: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count), sorted by group and gram, of one slice. A gram is up to three code points of 21 bits."""
    lower = [p.lower() for p in parts]
    chars = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(p) + 1 for p in lower), dtype=np.int64, count=len(parts))
    owner = np.concatenate([np.repeat(np.arange(len(parts)), size), [len(parts) - 1]])
    alpha = letters()[chars]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    keep[0] = True
    chars, owner, alpha = np.where(alpha, chars, 32)[keep], owner[keep], alpha[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[chars] = True
    points = np.flatnonzero(seen)
    code = np.zeros(0x110000, dtype=np.int64)
    code[points] = np.arange(1, len(points) + 1)
    c, bits = code[chars], int(len(points)).bit_length()
    who = group[owner] << (3 * bits)
    one = (who | c << 2 * bits)[alpha]
    two = (np.where(alpha[:-1], who[:-1], who[1:]) | c[:-1] << 2 * bits | c[1:] << bits)[alpha[:-1] | alpha[1:]]
    three = (who[1:-1] | c[:-2] << 2 * bits | c[1:-1] << bits | c[2:])[alpha[1:-1]]
    key, count = np.unique(np.concatenate([one, two, three]), return_counts=True)
    back = np.concatenate([[0], points])
    low = (1 << bits) - 1
    gram = back[key >> 2 * bits & low] << 42 | back[key >> bits & low] << 21 | back[key & low]
    return key >> 3 * bits, gram, count


def grams(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count), sorted by group and gram, over all texts."""
    found = [part_grams(group[at], parts) for at, parts in slices(texts)]
    g, gram, count = (np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in range(3))
    order = np.lexsort((gram, g))
    g, gram, count = g[order], gram[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (gram[1:] != gram[:-1])])) if len(g) else np.zeros(0, dtype=np.int64)
    return g[first], gram[first], np.add.reduceat(count, first) if len(first) else count


def training_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = pd.DataFrame({"lang": [], "gram": [], "n": []}).astype({"lang": object, "gram": np.int64, "n": np.int64})
    for pdf in batches:
        names, group = np.unique(pdf["lang"].to_numpy(dtype=object), return_inverse=True)
        g, gram, count = grams(list(pdf["text"]), group.astype(np.int64))
        total = pd.concat([total, pd.DataFrame({"lang": names[g], "gram": gram, "n": count})]).groupby(["lang", "gram"], as_index=False, sort=False)["n"].sum()
        if len(total) > 500_000:
            yield total
            total = total.iloc[:0]
    yield total


def learn_profiles(labelled: DataFrame, places: int = PLACES, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """The `places` most frequent n-grams of each language over all rows, most frequent first (ties: by the n-gram).

    - rows whose language or text is null are left out; a text without a letter counts nothing; repeated rows count each.
    - texts of any length are counted whole. Without rows there are no profiles. Other columns are not read.
    """
    bounded_batches(labelled.sparkSession)
    rows = Carried(labelled, lang=lang_col, text=text_col).df.select("lang", "text")
    counts = rows.where("lang is not null and text is not null").mapInPandas(training_counts, "lang string, gram long, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = summed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= places)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():  # at most `places` rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def distances(texts: list[str], profiles: list[list[int]], places: int) -> np.ndarray:
    """(text, profile): the mean out-of-place distance as a share of the largest, 1 for texts without letters."""
    known = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *map(np.array, profiles)]).astype(np.int64))
    place = np.full((len(known) + 1, len(profiles)), -1, dtype=np.int64)
    for k, p in enumerate(profiles):
        place[np.searchsorted(known, p), k] = np.arange(len(p))
    g, gram, count = grams(texts, np.arange(len(texts), dtype=np.int64))
    order = np.argsort(g << 32 | (1 << 31) - count, kind="stable")
    g, gram = g[order], gram[order]
    own = np.arange(len(g)) - np.searchsorted(g, np.arange(len(texts)))[g] if len(g) else g
    g, gram, own = g[own < places], gram[own < places], own[own < places]
    at = np.searchsorted(known, gram)
    at[known[np.minimum(at, len(known) - 1)] != gram] = len(known)
    theirs = place[at]
    apart = np.where(theirs < 0, places, np.abs(theirs - own[:, None]))
    n = np.bincount(g, minlength=len(texts))
    total = np.stack([np.bincount(g, weights=apart[:, k], minlength=len(texts)) for k in range(len(profiles))], axis=1)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None] / places, 1.0)


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], places: int = PLACES, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, the nearest profile's name (ties: the first by name), and score, 1 less its distance.

    - null text, text without a letter, or no profile at all: 'und' with score 0.
    - very long texts are counted in slices; repeated rows get the same result; an empty table stays empty.
    - columns of docs that are named lang_pred or score, in any case, are replaced; all others pass through untouched.
    """
    bounded_batches(docs.sparkSession)
    names = sorted(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        whole = ["" if t is None else t for t in texts]
        if not names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(whole), "score": [0.0] * len(whole)})
        d = distances(whole, [profiles[n] for n in names], places)
        best = d.argmin(axis=1)
        score = 1 - d[np.arange(len(d)), best]
        blank = np.array([not any(map(str.isalpha, t)) for t in whole], dtype=bool)
        return pd.DataFrame({"lang_pred": np.where(blank, UNKNOWN, np.array(names, dtype=object)[best]), "score": np.where(blank, 0.0, score)})

    own = Carried(docs, text=text_col)
    guessed = own.df.select("row", run("text").alias("guess"))
    return guessed.select(*own.columns({"lang_pred": F.col("guess.lang_pred"), "score": F.col("guess.score")}))


def fold(folds: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(fold(4) != 2).select("lang", "text"))
    held = docs.select("doc_id", "text", (fold(4) == 2).alias("held_out"))
    return predict_language(held, profiles).select("doc_id", "held_out", "lang_pred", "score")
