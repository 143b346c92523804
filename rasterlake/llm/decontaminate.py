"""Benchmark decontamination by templates.

Numbers, names and units are replaced with typed placeholders, and windows of five words of such templates are joined by
hash with those of the benchmark. A text that holds enough of an item's windows is compared with the item once more: what
stands for a placeholder of the item must be the same at all its places, so that re-parameterised questions are caught
and mere look-alikes are not.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.common import Carried, bounded_batches, join_groups, marked, sieve, stored, table

WORDS, SHARE, RUN = 5, 0.8, 13
#: Benchmark windows up to which they are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Parts that each window's hits are dealt into where they are joined by shuffle.
SALTS = 32

#: Units of measure and currency that count after a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz gram grams ton tons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "l ml liter liters litre litres w kw v a hz khz mhz ghz b kb mb gb tb mph kmh kph percent cent cents "
    "dollar dollars euro euros pound pounds usd eur gbp degrees"
).split()
ALNUM, DIGIT, UPPER, SPACE, END = 1, 2, 4, 8, 16
NUM, NAME, UNIT = (np.uint64(x) for x in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003))


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what a code point is, its lower case, powers for hashing); code points of over 16 bits are taken as small letters."""
    kind, low = np.full(1 << 16, ALNUM, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint64)
    for i in range((1 << 16) - 1):
        c = chr(i)
        kind[i] = ALNUM * c.isalnum() | DIGIT * c.isdecimal() | UPPER * c.isupper() | SPACE * c.isspace() | END * (c in ".!?:")
        low[i] = ord(c.lower()[0])
    power = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(256)], dtype=np.uint64)
    return kind, low, power


@dataclass
class Template:
    """Words of some texts in a row: hash or placeholder, whether it is one, and in which text from where to where."""

    h: np.ndarray
    slot: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def templates(texts: list[str | None]) -> Template:
    """The texts' words, lower-cased and without all but letters and digits.

    A number (digits first, with at most three letters on it), a capitalised word that does not begin a line or sentence,
    and a unit after a number become placeholders. Tokens without a letter or digit are left out.
    """
    whole = [t or "" for t in texts]
    kind, low, power = characters()
    points = np.frombuffer(("\n".join(whole) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = kind[np.minimum(points, 0xFFFF)]
    space = np.concatenate([[True], (c & SPACE) > 0])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    kept = np.flatnonzero(c & ALNUM)
    first = np.searchsorted(kept, starts)
    count = np.diff(first, append=len(kept))
    word = np.flatnonzero(count)
    first, count = first[word], count[word]
    if not len(word):
        return Template(*(np.zeros(0, dtype=t) for t in (np.uint64, bool, np.int64, np.int64, np.int64)))
    rank = np.arange(len(kept)) - np.repeat(first, count)
    k, own = c[kept], points[kept]
    small = np.where(own > 0xFFFF, own.astype(np.uint64), low[np.minimum(own, 0xFFFF)])
    h = mixed(np.add.reduceat((small + np.uint64(1)) * power[rank & 255], first))
    digits, uppers = (np.add.reduceat((k & bit) > 0, first, dtype=np.int64) for bit in (DIGIT, UPPER))
    number = ((k[first] & DIGIT) > 0) & (count - digits <= 3)
    capital = ((k[first] & UPPER) > 0) & (uppers == 1) & (count > 1) & (digits == 0)
    stops = np.concatenate([[0], np.cumsum((c[ends - 1] & END) > 0)])[word] + np.cumsum(points == 10)[starts[word]]
    begins = np.concatenate([[True], stops[1:] > stops[:-1]])
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in whole])])
    text = np.searchsorted(base, starts[word], side="right") - 1
    after = np.flatnonzero(number[:-1] & (text[1:] == text[:-1])) + 1
    unit = np.zeros(len(h), dtype=bool)
    unit[after[np.isin(h[after], unit_hashes())]] = True
    name = capital & ~begins
    for mask, value in ((number, NUM), (name, NAME), (unit, UNIT)):
        h[mask] = value
    return Template(h, number | name | unit, text, starts[word] - base[text], ends[word] - base[text])


@lru_cache(maxsize=1)
def unit_hashes() -> np.ndarray:
    _, _, power = characters()
    return mixed(np.array([sum((ord(x) + 1) * int(power[i]) for i, x in enumerate(u)) % (1 << 64) for u in UNITS], dtype=np.uint64))


def windows(t: Template) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of five words of one text, of which at least two are not placeholders."""
    n = len(t.h) - WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        key = (key ^ t.h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    at = np.flatnonzero((slots[WORDS:] - slots[:-WORDS] <= WORDS - 2) & (t.text[WORDS - 1 :] == t.text[:n]))
    return at, key[at].view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def window_hashes(texts: pd.Series) -> pd.Series:
    """A text's windows; one that stands twice may be given twice."""
    out = []
    for at in range(0, len(texts), 256):
        part = list(texts.iloc[at : at + 256])
        t = templates(part)
        place, key = windows(t)
        out += np.split(key, np.searchsorted(t.text[place], np.arange(1, len(part))))
    return pd.Series(out, dtype=object)


def value(source: str, t: Template, k: int) -> str:
    """What stands at word k."""
    return source[t.start[k] : t.end[k]].lower().strip(".,;:!?\"'()[]{}")


def compare(text: str | None, item: str | None) -> tuple[float, int, dict[str, str]]:
    """(share of the item's different windows that the text holds with consistent slots, words of the longest run of
    such windows, what stands for the item's placeholders)."""
    ours, theirs = templates([text]), templates([item])
    (tpos, tkey), (ipos, ikey) = windows(ours), windows(theirs)
    if not len(ikey):
        return 0.0, 0, {}
    places = defaultdict(list)
    shared = np.isin(tkey, ikey)
    for p, k in zip(tpos[shared].tolist(), tkey[shared].tolist(), strict=True):
        places[k].append(p)
    pairs = [(i, t, k) for i, k in zip(ipos.tolist(), ikey.tolist(), strict=True) for t in places.get(k, ())]
    # Where a window stands at several places, those on the most common diagonals weigh most.
    diagonal = Counter(t - i for i, t, _ in pairs)

    votes = defaultdict(Counter)
    for i, t, _ in pairs:
        for k in range(WORDS):
            if theirs.slot[i + k]:
                votes[value(item, theirs, i + k)][value(text, ours, t + k)] += diagonal[t - i]
    bound = {a: min(c, key=lambda b, c=c: (-c[b], b)) for a, c in votes.items()}
    good = {(i, k) for i, t, k in pairs if all(not theirs.slot[i + j] or bound[value(item, theirs, i + j)] == value(text, ours, t + j) for j in range(WORDS))}
    on = {i for i, _ in good}
    run = best = 0
    for i in ipos.tolist():
        run = (run + 1 if i - 1 in on else 1) if i in on else 0
        best = max(best, run)
    return len({k for _, k in good}) / len(set(ikey.tolist())), best + WORDS - 1 if best else 0, bound


@F.pandas_udf(T.StructType([T.StructField("containment", T.DoubleType()), T.StructField("run", T.LongType()), T.StructField("slots", T.MapType(T.StringType(), T.StringType()))]))
def comparison(texts: pd.Series, items: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(t, i) for t, i in zip(texts, items, strict=True)], columns=["containment", "run", "slots"])


@F.pandas_udf(T.LongType())
def template_class(items: pd.Series) -> pd.Series:
    """A hash of the item's template and of which of its slots have the same value: items that agree in both leak from the
    same texts."""
    out = []
    for text in items:
        t, seen = templates([text]), {}
        same = [seen.setdefault(value(text, t, k), len(seen)) for k in np.flatnonzero(t.slot)]
        out.append(xxhash.xxh64_intdigest(t.h.tobytes() + b"|" + np.array(same, dtype="<i8").tobytes()) - (1 << 63))
    return pd.Series(out, dtype="int64")


def item_classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, class, text): the benchmark's different items with a text, and a hash of their class."""
    own = Carried(benchmark, item_id=item_col, text=text_col).df.select("item_id", "text").where("text is not null").distinct()
    return own.select("item_id", template_class("text").alias("class"), "text")


def spread_join(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """hits joined with keys on `_key`: by broadcast if there are few keys, else by shuffle, with the keys repeated for
    SALTS parts of each key's hits, as one window may be in a third of all texts."""
    if keys.count() <= BROADCAST_WINDOWS:
        return hits.join(F.broadcast(keys), "_key")
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"]).drop("_salt")


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, _h, item_id, n_items, containment, run, slots) for each text and class of benchmark items that it leaks; _h is
    the text's hash.

    A text leaks an item if it holds, with consistent slots, at least `share` of the item's different windows, or a run
    of at least `run` words of it. Items of one template (see template_class) are compared once: item_id is the smallest of
    them, n_items how many there are, and item_classes gives them all.

    Pairs to compare are found exactly: a text that holds enough of an item's windows holds one of its rarest, where as many
    of its windows are left out as may be missing; so windows that most items share make no pairs.

    - null texts, and texts or items of under five words (or with placeholders only), hold no window and never match.
    - null ids pass through; rows that repeat an id and text give one row; a null item_id is an item like others.
    - repeated items are found once; texts of any length are read whole. Other columns are not read, whatever their names.
      Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    first = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "text")).alias("i")
    item = item_classes(benchmark, item_col, item_text_col).groupBy(F.col("class").alias("_ih")).agg(first, F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull()).alias("n_items"))
    item = stored(item.select("_ih", "n_items", F.col("i.item_id").alias("_item"), F.col("i.text").alias("_item_text")).withColumn("_keys", F.array_distinct(window_hashes("_item_text"))), "items")
    of = F.size("_keys")
    enough = F.least(F.ceil(of * F.lit(share)), F.lit(run - WORDS + 1)).cast("int")
    item = item.where(of > 0).withColumn("_enough", F.greatest(enough, F.lit(1)))
    keys = item.select("_ih", (of - F.col("_enough") + 1).alias("_kept"), F.explode("_keys").alias("_key"))
    often = stored(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "windows")
    total = often.agg(F.sum("_n")).first()[0] or 0
    by_rarity = Window.partitionBy("_ih").orderBy("_n", "_key")  # the windows of one item
    rare = stored(join_groups(keys, often, ["_key"], total).withColumn("_place", F.row_number().over(by_rarity)).where("_place <= _kept").select("_ih", "_key"), "rare")

    rows = Carried(docs, _id=id_col, _text=text_col).df.select("_id", "_text").where("_text is not null").withColumn("_h", F.xxhash64("_id", "_text"))
    hits = stored(spread_join(rows.select("_h", F.explode(window_hashes("_text")).alias("_key")), often.select("_key")).distinct(), "hits")
    near = stored(spread_join(hits, rare).select("_h", "_ih").distinct(), "near")
    full = join_groups(near, item.select("_ih", "_keys", "_enough").join(near.groupBy("_ih").agg(F.count(F.lit(1)).alias("_n")), "_ih"), ["_ih"], near.count())
    held = full.select("_h", "_ih", "_enough", F.explode("_keys").alias("_key")).join(hits, ["_h", "_key"]).groupBy("_h", "_ih", "_enough").count()
    likely = stored(held.where("count >= _enough").select("_h", "_ih"), "likely")

    some = marked(rows, "_h", *sieve(likely.select("_h").distinct(), "_h")).where("_may").drop("_may")
    pairs = some.join(likely, "_h").dropDuplicates(["_h", "_ih"])
    known = item.select("_ih", "_item", "_item_text", "n_items").join(likely.groupBy("_ih").agg(F.count(F.lit(1)).alias("_n")), "_ih")
    pairs = join_groups(pairs, known, ["_ih"], likely.count())
    checked = pairs.select(F.col("_id").alias(id_col), "_h", F.col("_item").alias("item_id"), "n_items", comparison("_text", "_item_text").alias("_c")).select(id_col, "_h", "item_id", "n_items", "_c.*")
    return checked.where((F.col("containment") >= share) | (F.col("run") >= run))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text leaks no benchmark item; null texts stay."""
    leaks = stored(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col).select("_h").distinct().withColumnRenamed("_h", "leak"), "leaks")
    own = Carried(docs, id=id_col, text=text_col)
    rows = own.df.select("row", F.xxhash64("id", "text").alias("h"))
    rows = marked(rows, "h", *sieve(leaks.withColumnRenamed("leak", "h"), "h"))
    sure = rows.where("not _may")
    judged = rows.where("_may").join(leaks, F.col("h") == F.col("leak"), "left_anti")
    return sure.unionByName(judged).select(*own.columns())


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_items", "containment", F.col("run").alias("run_words"), F.size("slots").alias("n_slots"))
