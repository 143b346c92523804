"""A training corpus from raw documents: each stage takes and returns documents, the last one packs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import decontaminate, langid, line_dedup, packing, simhash
from rasterlake.llm.common import Carried, scratch, stored, table

#: Known languages have 0.38 or more in sf0.1's documents of any length; lines in Portuguese, Polish, Finnish and Swedish, and
#: rows of keys typed at random, had 0.20 to 0.324.
LEAST_SCORE = 0.33


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble none of the languages that lang names.

    - null, empty and letterless texts go; null langs are not learned from, and their rows are judged by their text.
    - texts of any length are read whole; a tie between languages does not matter here; repeated rows fare alike.
    - without any lang there is nothing to compare with, and all texts with a letter stay. An empty table stays empty.
    - all columns are kept as they are, whatever their names.
    """
    own = Carried(docs, lang="lang", text="text")
    profiles = langid.learn_profiles(own.df.select("lang", "text"))
    if not profiles:
        return own.df.where(F.col("text").rlike(r"\p{L}")).select(*own.columns())
    guessed = langid.predict_language(own.df.select("row", "text"), profiles)
    return guessed.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own.columns())


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts without the lines that other documents keep; n_chars follows. No row goes.

    - null texts become ''; null ids count as no document, and their rows lose every frequent line.
    - texts may have any number of lines; of documents that share a line the largest id keeps it; repeated rows lose the
      same lines. An empty table stays empty.
    - all other columns are kept as they are, whatever their names; n_chars is left out if docs has none.
    """
    own = Carried(docs, doc_id="doc_id", text="text")
    lines = line_dedup.dedup_lines(own.df.select("row", "doc_id", "text"))
    put = {"text": F.col("text")}
    if "n_chars" in (x.lower() for x in docs.columns):
        put["n_chars"] = F.length("text").cast("long")
    return lines.select(*own.columns(put=put))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of five-word Jaccard similarity 0.8 join; SimHash and the chains of its
    rings (pigeonring) find the candidates.

    - null, empty and blank texts are copies of each other; rows with a null id stay and stand for none.
    - texts of any length are read whole; the smallest id stays, of ties on it the smaller text hash; repeated rows stay
      once. An empty table stays empty. All columns are kept as they are, whatever their names.
    """
    return simhash.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark.

    - null texts, and null, empty and very short items, match nothing; rows with a null id are judged by their text.
    - texts of any length are read whole; repeated rows fare alike; an empty benchmark drops none; an empty table stays
      empty. All columns are kept as they are, whatever their names.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, one row for each piece of a document.

    - null and empty texts are their end id alone; null ids pass through; texts of any length are cut into pieces.
    - ties on the curve are ordered by id; repeated rows are packed each. An empty table gives no pieces. Other columns than
      doc_id and text are not read, whatever their names.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_dedup", near_dedup), ("decontamination", drop_benchmark), ("packing", pack)]

#: Tokenising and SimHash are not for SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. Of the scratch tables only the documents before packing stay, and what packing reads."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):  # what a stage has stored goes at its end, its result at the end of all, but for the last
                docs = stored(stage(spark, docs, sf_dir), name, kept=2 if name == STAGES[-2][0] else 1)
    return STAGES[-1][1](spark, docs, sf_dir)
