"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks, trained on labelled sentences.

The kernel of two words counts their common subsequences of three characters, each weighted down by the length it spans in
either word, so that inserted characters and changed endings lower a match instead of losing it. Over a text's words, the
largest kernel with a landmark and the mean of a high power of it, both whitened by the landmarks' own kernel matrix (Nyström's
method), are the features of a linear machine that is trained on whole texts with their own labels; a logistic function
fitted on its decisions for labelled texts gives the score. Landmarks are words and parts of words that labelled toxic texts
hold far more often than others.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, bounded_batches, stored, table
from rasterlake.llm.langid import fold

#: Labelled texts that the model is fitted on, at most; landmarks, at most, and parts of words that they are chosen from.
SAMPLE, LANDMARKS, RANKED = 10_000, 64, 2_000
#: Characters of parts of words that may be landmarks: from inside, and from the start; and how far more often toxic texts
#: must hold one.
INNER, PREFIX, TYPICAL = 5, 8, 4
#: Words are compared in parts of SPAN characters that overlap by half. Characters of a subsequence are up to GAP apart.
SPAN, GAP, DECAY, RIDGE = 24, 3, 0.7, 1.0
#: Powers of the kernel: for the largest one in a text, and for the mean over its words (of which SMOOTH more count as unlike).
MOST, MEAN, SMOOTH = 2, 8, 20
#: Characters of texts that are taken apart together, and words whose features are computed together.
SLICE, CHUNK = 1 << 20, 8_192
START = 1
#: Subsequences that the landmarks' letters may make, of which a table is made; beyond that they are searched.
DENSE = 1 << 22


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """(0 for white space, 1 for ASCII punctuation, 2 for others; lower case) of the first 65,536 code points."""
    kind, low = np.full(1 << 16, 2, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range((1 << 16) - 1):
        kind[i] = 0 if chr(i).isspace() else 2
        low[i] = ord(chr(i).lower()[0])
    kind[[ord(c) for c in string.punctuation]] = 1
    return kind, low


@dataclass
class Parts:
    """Parts of texts' words: where each begins in `points`, its characters, if it begins its word, and the text."""

    points: np.ndarray
    first: np.ndarray
    size: np.ndarray
    begins: np.ndarray
    text: np.ndarray

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Rows of START or 0, the part's characters, and 0 after its end."""
        out = np.zeros((len(at), 1 + max(3, int(self.size[at].max(initial=0)))), dtype=np.uint32)
        place = np.arange(out.shape[1] - 1)[None, :]
        inside = place < self.size[at, None]
        out[:, 1:][inside] = self.points[(self.first[at, None] + place)[inside]]
        out[:, 0] = np.where(self.begins[at], START, 0)
        return out

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """(one of each different part, which of them each part is)."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, dtype=np.uint64))
            h = np.zeros(len(self.first), dtype=np.uint64)
            for k in range(int(self.size.max(initial=0))):
                own = np.flatnonzero(self.size > k)
                x = self.points[self.first[own] + k].astype(np.uint64) + np.uint64(2)
                h[own] += (x ^ x << np.uint64(21)) * power[k]
            h = (h + self.begins.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        _, one, which = np.unique(h ^ h >> np.uint64(32), return_index=True, return_inverse=True)
        return one, which


def parts_of(texts: list[str | None]) -> Parts:
    """Lower-cased words without ASCII punctuation; a run of three or more words of one character is also one word. Words
    over SPAN characters are cut into parts, so that any SPAN / 2 characters in a row are in one part."""
    kind, low = characters()
    points = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    k = kind[np.minimum(points, 0xFFFF)]
    space = np.concatenate([[True], k == 0])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    kept = np.concatenate([[0], np.cumsum(k == 2)])
    first, size = kept[starts], kept[ends] - kept[starts]
    base = np.cumsum([len(t or "") + 1 for t in texts])
    text = np.searchsorted(base, starts, side="right")
    first, size, text = first[size > 0], size[size > 0], text[size > 0]
    own = points[k == 2]
    own = np.where(own > 0xFFFF, own, low[np.minimum(own, 0xFFFF)])
    single = np.flatnonzero(size == 1)
    if len(single):
        new = np.flatnonzero(np.concatenate([[True], (np.diff(single) > 1) | (np.diff(text[single]) > 0)]))
        long = np.diff(new, append=len(single))
        run = single[new[long > 2]]
        first, size, text = np.concatenate([first, first[run]]), np.concatenate([size, long[long > 2]]), np.concatenate([text, text[run]])
    many = np.maximum(1, -(-(size - SPAN // 2) // (SPAN // 2)))
    word = np.repeat(np.arange(len(size)), many)
    step = (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)) * (SPAN // 2)
    return Parts(own, first[word] + step, np.minimum(size[word] - step, SPAN), step == 0, text[word])


def gaps() -> list[tuple[int, int]]:
    return [(a, b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]


@lru_cache(maxsize=1)
def own_kernel() -> np.ndarray:
    """By length, START included: the kernel of a word of different characters with itself."""
    n = np.arange(SPAN + 2)
    return sum(np.maximum(n - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in gaps())


class Landmarks:
    """The landmarks' subsequences as a table, and words' kernels with the landmarks by it."""

    def __init__(self, marks: list[str]):
        codes, self.own = self.codes(marks)
        self.letters = np.unique(codes)[1:]
        place, key, weight = self.triples(codes)
        self.keys, at = np.unique(key, return_inverse=True)
        # Of each key the landmarks that have it, next to each other, and its weight in them.
        held, which = np.unique(at * len(marks) + place, return_inverse=True)
        self.mark, self.weight = held % max(len(marks), 1), np.bincount(which, weight, len(held))
        self.first = np.searchsorted(held, np.arange(len(self.keys) + 1) * len(marks))
        self.marks = len(marks)
        self.table = None
        if (len(self.letters) + 1) ** 3 <= DENSE:
            self.table = np.full((len(self.letters) + 1) ** 3, len(self.keys), dtype=np.int32)
            self.table[self.keys] = np.arange(len(self.keys))
        norm = np.sqrt(np.where(self.own > 0, self.own, 1))
        self.gram = self.sums(codes) / norm[:, None] / norm[None, :]

    @staticmethod
    def codes(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows as those of Parts.codes, the kernels of different characters of that many with themselves)."""
        codes, size = np.zeros((len(marks), SPAN + 1), dtype=np.uint32), np.zeros(len(marks), dtype=np.int64)
        for row, m in enumerate(marks):
            body = m.removeprefix("^")[:SPAN]
            codes[row, 0] = START if m[:1] == "^" else 0
            codes[row, 1 : 1 + len(body)] = list(map(ord, body))
            size[row] = len(body) + (m[:1] == "^")
        return codes, own_kernel()[size]

    def triples(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, subsequence, weight) of all subsequences of the landmarks' letters."""
        n = len(self.letters) + 1
        at = np.searchsorted(self.letters, codes)
        c = np.where(self.letters[np.minimum(at, n - 2)] == codes, at + 1, 0) if n > 1 else np.zeros(codes.shape, dtype=np.int64)
        rows, keys, weights = [], [], []
        for a, b in gaps():
            wide = c.shape[1] - a - b
            if wide <= 0:
                continue
            x, y, z = c[:, :wide], c[:, a : a + wide], c[:, a + b :]
            row, col = np.nonzero((x > 0) & (y > 0) & (z > 0))
            rows.append(row)
            keys.append((x[row, col] * n + y[row, col]) * n + z[row, col])
            weights.append(np.full(len(row), DECAY ** (a + b + 1), dtype=np.float32))
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((rows, np.int64), (keys, np.int64), (weights, np.float32)))

    def placed(self, key: np.ndarray) -> np.ndarray:
        """Where the keys stand among the landmarks', or their number: by a table, or by search where that would be large."""
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys)) if len(self.keys) else at

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """(word, landmark): kernels."""
        row, key, weight = self.triples(codes)
        found = self.placed(key)
        hit = np.flatnonzero(found < len(self.keys))
        found, row, weight = found[hit], row[hit], weight[hit]
        many = self.first[found + 1] - self.first[found]
        at = np.arange(many.sum()) + np.repeat(self.first[found] - (np.cumsum(many) - many), many)
        pair = np.repeat(row * self.marks, many) + self.mark[at]
        return np.bincount(pair, self.weight[at] * np.repeat(weight, many), len(codes) * self.marks).astype(np.float32).reshape(len(codes), self.marks)

    def kernels(self, codes: np.ndarray) -> np.ndarray:
        """(word, landmark): how much of the landmark the word holds, the kernel in terms of the landmark's own; 1 at most."""
        return np.minimum(self.sums(codes) / np.where(self.own > 0, self.own, 1), 1)

    def whitener(self, power: int) -> np.ndarray:
        """The inverse square root of the landmarks' kernel matrix."""
        values, vectors = np.linalg.eigh(self.gram**power)
        return vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T

    def likeness(self, texts: list[str | None]) -> np.ndarray:
        """(text, twice the landmarks): the words' largest kernels, and the logarithms of how many in a hundred are alike."""
        n = self.marks
        most, total, words = np.zeros((len(texts), n), dtype=np.float32), np.zeros((len(texts), n)), np.zeros(len(texts))
        at, chars = 0, 0
        for end, t in enumerate(texts, 1):
            chars += len(t or "")
            if chars < SLICE and end < len(texts):
                continue
            parts = parts_of(texts[at:end])
            one, which = parts.different()
            k = np.concatenate([self.kernels(parts.codes(one[i : i + CHUNK])) for i in range(0, len(one), CHUNK)] or [np.zeros((0, n), dtype=np.float32)])
            power = k.astype(np.float64) ** MEAN
            order = np.argsort(parts.text, kind="stable")
            for i in range(0, len(order), 8 * CHUNK):
                some = order[i : i + 8 * CHUNK]
                text = at + parts.text[some]
                cuts = [0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(some)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own, t = which[some[a:b]], text[a]
                    most[t] = np.maximum(most[t], k[own].max(axis=0))
                    total[t] += power[own].sum(axis=0)
                    words[t] += b - a
            at, chars = end, 0
        return np.hstack([most**MOST, np.log1p(100 * total / (words + SMOOTH)[:, None]).astype(np.float32)])


@dataclass
class Model:
    """decision(text) = likeness to the landmarks @ weights + bias; score(text) = logistic of slope * decision + shift."""

    marks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """A linear machine with squared hinge loss by Newton's method; the last weight is the bias. y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        a = x[y * (x @ w) < 1]
        new = np.linalg.solve(keep + a.T @ a, a.T @ y[y * (x @ w) < 1])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit_logit(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic function of the decisions, by damped Newton steps."""
    x, w = np.stack([d, np.ones(len(d))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.03 * np.eye(2), x.T @ (y - p) - 0.03 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.0), float(w[1])


def excess(a, b, toxic: float, clean: float):
    """How surprising it is (a G statistic) that a of `toxic` and b of `clean` texts hold something; 0 if too few toxic."""
    share = toxic / (toxic + clean)
    ea, eb = (a + b) * share, (a + b) * (1 - share)
    g = 2 * (F.when(a > 0, a * F.log(a / ea)).otherwise(0.0) + F.when(b > 0, b * F.log(b / eb)).otherwise(0.0))
    return F.when(a > ea, g).otherwise(0.0)


def choose_landmarks(ranked: list[str], most: int = LANDMARKS) -> list[str]:
    """The first marks that neither hold nor are part of an earlier one, and are not much like one."""
    out: list[str] = []
    known = Landmarks(out)
    for mark in ranked:
        if len(out) == most:
            break
        if len(mark) < 3 or any(mark in o or o in mark for o in out):
            continue
        codes, own = Landmarks.codes([mark])
        if not out or (known.sums(codes) / np.sqrt(own * known.own)).max() < 0.5:
            out.append(mark)
            known = Landmarks(out)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model on the texts of docs with labels (above 0 is toxic), of which `sample` are taken, in the order of their
    ids' hashes; these are few enough to be broadcast.

    Word statistics are Spark aggregates; what comes to the driver is bounded by SAMPLE, LANDMARKS and RANKED.

    - null ids, labels and texts are left out; an id with several labels is toxic if one is; repeated texts count each.
    - without both labels, or if nothing is typical of toxic texts, the model scores all texts alike. Ties of landmarks
      are broken by their length, then alphabetically. Other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    labelled = Carried(labels, id=id_col, toxic=label_col).df.where("id is not null and toxic is not null").groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    labelled = labelled.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = Carried(docs, id=id_col, text=text_col).df.where("text is not null").select("id", "text")
    rows = stored(texts.join(F.broadcast(labelled), "id").select("text", "toxic"), "labelled")
    toxic, clean = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not toxic or not clean:
        return Model(shift=-6.0 if clean else 6.0 if toxic else 0.0)
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\p{Punct}+", "")), r"\s+")
    vocabulary = rows.select("toxic", F.explode(F.array_distinct(words)).alias("word")).groupBy(F.concat(F.lit("^"), F.left("word", F.lit(SPAN))).alias("word")).agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    vocabulary = stored(vocabulary, "words")
    parts = F.expr(f"concat(transform(sequence(4, {PREFIX}), n -> left(word, n)), transform(sequence(1, length(word)), i -> substr(word, i, {INNER})), array(word))")
    features = vocabulary.select(F.explode(F.array_distinct(parts)).alias("mark"), "a", "b").where(F.length("mark").between(4, 12))
    marks = features.groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = vocabulary.count()
    often_toxic = F.col("a") * clean > TYPICAL * F.col("b") * toxic
    typical = marks.withColumn("g", excess(F.col("a"), F.col("b"), toxic, clean)).where((F.col("g") > 2 * math.log(max(size, 2)) + 4) & often_toxic)
    ranked = [r["mark"] for r in typical.orderBy(F.desc(F.round("g")), F.desc(F.length("mark")), "mark").limit(RANKED).collect()]
    chosen = choose_landmarks(ranked)
    if not chosen:
        return Model(shift=math.log(toxic / clean))
    found = rows.select("toxic", likeness(chosen)("text").alias("k")).toArrow()
    x = found["k"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * len(chosen)).astype(float)
    y = found["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums do not depend on which task came first
    x, y = x[order], y[order]
    known, n = Landmarks(chosen), len(chosen)
    whiten = np.zeros((2 * n, 2 * n))
    whiten[:n, :n], whiten[n:, n:] = known.whitener(MOST), known.whitener(MEAN)
    machine = fit_machine(x @ whiten, 2 * y - 1, RIDGE)
    model = Model(chosen, whiten @ machine[:-1], float(machine[-1]))
    model.slope, model.shift = fit_logit(x @ model.weights + model.bias, y)
    return model


def likeness(marks: list[str]):
    """text -> its likeness to the landmarks."""
    known: list[Landmarks] = []

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(Landmarks(marks))
        return pd.Series(list(known[0].likeness(list(texts))), dtype=object)

    return run


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with toxicity, from 0 to 1.

    - null, empty and wordless texts are scored as texts with no word like a landmark.
    - words of over 24 characters are compared in overlapping parts; whole texts of any length are read.
    - repeated rows get the same score; an empty table stays empty; a column named toxicity, in any case, is replaced.
    """
    bounded_batches(docs.sparkSession)
    own = Carried(docs, text=text_col)
    known: list[Landmarks] = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not model.marks:
            decisions = np.full(len(texts), model.bias)
        else:
            if not known:
                known.append(Landmarks(model.marks))
            decisions = known[0].likeness(list(texts)).astype(float) @ model.weights + model.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(model.slope * decisions + model.shift, -500, 500))))

    return own.df.select("row", run("text").alias("p")).select(*own.columns({"toxicity": F.col("p")}))


def op1_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(5) != 0))
    out = score_toxicity(docs.select("doc_id", "text", (fold(5) == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
