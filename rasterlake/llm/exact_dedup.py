"""Exact dedup by progressive refinement: texts of one length, then of one prefix hash, then of one full hash.

Each step looks only at rows that the step before could not tell apart. Lengths and prefix hashes that more than one row has
become bitmaps of bounded size, which are broadcast: a row that is not in them is alone, and its text is not hashed. A bit
that another key has set lets a row through for nothing, which costs a hash and no wrong result, as only the full hash
decides. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import ASCII_SPACE, Carried, join_groups, marked, sieve, stored, table

#: Characters of the prefix.
PREFIX = 64


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def shared(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """The sieve of the hashes in a column that more than one of the rows has."""
    return sieve(stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), name), key)


def refined(own: DataFrame) -> DataFrame:
    """own (which has `_text`) with `_squeezed` and `_may`: whether its length and prefix may be another row's, too."""
    own = own.withColumn("_squeezed", squeezed(F.col("_text")))
    own = own.withColumn("_size", F.length("_squeezed")).withColumn("_head", F.xxhash64("_size", F.substring("_squeezed", 1, PREFIX)))
    sizes = stored(own.select("_size", "_head"), "sizes")
    some = marked(sizes, "_size", *shared(sizes, "_size", "lengths")).where("_may").drop("_may")
    return marked(own, "_head", *shared(some, "_head", "prefixes")).drop("_size", "_head")


def full_hash() -> Column:
    return F.unhex(F.sha2("_squeezed", 256))


def firsts(rows: DataFrame, *last: str) -> DataFrame:
    """(_full, _n, _first) of the full hashes that more than one of the rows has: the row with the most code points, of
    these the one with the smallest id (null ids come last), told by the columns chars, id and those of `last`."""
    order = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), *last)
    return stored(rows.groupBy("_full").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).where("_n > 1"), "exact")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept) for each row; texts are equal if they are identical without ASCII white space.

    Of equal texts the row with the most code points, then the smallest id stays; keep_id is its id. digest_col names
    another column for the SHA-256 of the squeezed text (lowercase hex), which is then taken of texts that are alone, too.

    - null texts are empty, and equal to all texts of white space alone.
    - null ids come last among ties; a group whose row that stays has none has a null keep_id.
    - repeated rows (same id, same text) are in one group, and just one of them is kept.
    - texts of any length are read whole; groups may be of any size; an empty table gives no rows. Other columns of docs are
      not read, whatever their names.
    """
    rows = refined(Carried(docs, _id=id_col, _text=text_col).df.select("_id", "_text"))
    full = full_hash() if digest_col else F.when(F.col("_may"), full_hash())
    rows = rows.select("_id", F.length(F.coalesce("_text", F.lit(""))).alias("_chars"), "_may", full.alias("_full"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "hashed")
    met = rows.where("_may")
    grouped = join_groups(met, firsts(met, "_row"), ["_full"], met.count(), "left")
    one = grouped.unionByName(rows.where("not _may").withColumns({"_n": F.lit(None).cast("long"), "_first": F.lit(None).cast(grouped.schema["_first"].dataType)}))
    alone = F.col("_n").isNull()
    out = {
        id_col: F.col("_id"),
        "keep_id": F.when(alone, F.col("_id")).otherwise(F.col("_first.id")),
        "group_size": F.coalesce("_n", F.lit(1)).cast("long"),
        "kept": F.coalesce(F.col("_first._row") == F.col("_row"), F.lit(True)),
        **({digest_col: F.lower(F.hex("_full"))} if digest_col else {}),
    }
    return one.select(*[c.alias(name) for name, c in out.items()])


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever their names.

    Nulls, ties, repeated rows and empty tables are as there. Only rows whose length and prefix another row has, too, meet by
    their hashes; those of hot hashes are told where they are (see join_groups).
    """
    own = Carried(docs, _id=id_col, _text=text_col)
    rows = refined(own.df).withColumn("_chars", F.length(F.coalesce("_text", F.lit(""))))
    met = rows.where("_may").withColumn("_full", full_hash()).drop("_squeezed", "_text", "_may")
    narrow = stored(met.select("_id", "_chars", "_full"), "hashed")
    judged = join_groups(met, firsts(narrow), ["_full"], narrow.count(), "left")
    same = (F.col("_first.chars") == -F.col("_chars")) & F.col("_first.id").eqNullSafe(F.col("_id"))
    one = judged.where(same).dropDuplicates(["_full"])
    return rows.where("not _may").select("row").unionByName(judged.where("_n is null").select("row")).unionByName(one.select("row")).select(*own.columns())


def op11_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_col="text_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER s AS place, first_value(doc_id) OVER s AS keep_id
  FROM d WINDOW s AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
