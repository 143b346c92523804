"""Line dedup: lines that many documents share are kept in one document only.

Explode the lines, normalise and hash them, count the distinct documents of each hash, and drop the lines of
hashes over the threshold everywhere but in the largest document id; the rest is reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import ASCII_SPACE, Carried, join_groups, let, row_key, stored, table


def trimmed(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.trim(line, F.lit(ASCII_SPACE))


def folded(line: Column) -> Column:
    """Equal for lines that are equal but for the case of A-Z, and for no others.

    The line's bytes are lower-cased as Latin-1 characters, which is quick. That changes A-Z, and the first byte of some
    characters of two bytes into one that begins three or four; how many bytes follow it still tells the two apart.
    """
    return F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and n_lines (before dropping) and n_dropped.

    A line goes if its key has at least min_chars code points and is found in at least min_docs documents,
    unless the row's id is the largest one that holds it. Repeated lines of one document count as one document.

    - null or empty text: one empty line, which is never dropped; the text becomes ''.
    - null ids count as no document and are never the largest: such rows lose every frequent line.
    - repeated rows (same id, same text) each stay and lose the same lines.
    - same id, other text: each row loses its own lines; together they count as one document.
    - columns of docs that are named n_lines or n_dropped, in any case, are replaced; others pass through.
    - an empty table gives an empty table. Texts may have any number of lines.

    Lines are split and hashed once and stored as 128-bit hashes with their place. Counting goes through partial
    aggregates by (hash, id), so that a line which a third of all documents hold is summed up before it is shuffled; lines
    of such hot hashes are then marked where they are (see join_groups).
    """
    own = Carried(docs, _id=id_col, _text=text_col)
    base = own.df.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_rk", row_key("_id", "_text"))
    lines = base.select("_id", "_rk", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line")).where(F.length("_line") >= min_chars)
    lines = lines.withColumn("_line", trimmed(F.col("_line"))).where(F.length("_line") >= min_chars).withColumn("_key", folded(F.col("_line")))
    lines = lines.select("_id", "_rk", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    lines = stored(lines, "lines")
    holders = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = holders.groupBy("_h1", "_h2").agg(F.count("_id").alias("_docs"), F.max("_id").alias("_last"), F.sum("_n").alias("_n"))
    frequent = stored(counted.where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_last", "_n"), "frequent")
    dropped = join_groups(lines, frequent, ["_h1", "_h2"], lines.count()).where(~F.col("_id").eqNullSafe(F.col("_last")))
    drops = dropped.groupBy("_id", "_rk").agg(F.collect_set("_pos").alias("_drops")).withColumnRenamed("_id", "_id2").withColumnRenamed("_rk", "_rk2")
    out = base.join(drops, (F.col("_rk") == F.col("_rk2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")
    none = F.array().cast("array<int>")
    rewritten = F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(
        let(
            F.split("_text", "\n", -1),
            lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.coalesce("_drops", none)), lambda i: own[i]), "\n"),
        )
    )
    new = {"n_lines": F.size(F.split("_text", "\n", -1)).cast("long"), "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long")}
    return out.select(*own.columns(new, {text_col: rewritten}))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
l AS (SELECT rn, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rn
"""
