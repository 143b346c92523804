"""What the text operators share: scratch tables, row keys, columns that pass through, and joins that bear hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A key held by more than one in HOT of all rows is hot; so there are at most HOT hot keys, however large the table is.
HOT = 10_000
#: Bits a hash in a sieve, while it has fewer than MOST_BITS (16 MB); bits of one of bitmap_construct_agg's bitmaps.
BITS_A_KEY, MOST_BITS, BITMAP = 16, 1 << 27, 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local one is made only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterlake-"))
    return sc.getCheckpointDir()


class Scopes(threading.local):
    """The blocks of scratch() that the thread is in, with what each is to delete."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = Scopes()


def stored(df: DataFrame, name: str, kept: int = 0) -> DataFrame:
    """df written once as Parquet to the shared checkpoint folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks that read the table. The table outlives `kept` of
    the blocks of scratch() that it is written in.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if len(_scopes.open) > kept:
        _scopes.open[-1 - kept].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is stored within the block, at its end, but for what is stored to outlive it."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lets a Python worker take at most 1000 rows, and about 8 MB, at a time; smaller settings stay.

    The session keeps these settings, as batches are made only when a result is computed.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Carried:
    """A table of any column names, to compute with without clashes: df has one struct column `row`, whose fields are
    numbered, and what is asked for by name. Names that differ only in case, or repeat, are no ambiguity here."""

    def __init__(self, df: DataFrame, **needed: str):
        self.names = df.columns
        fields = [f"c{i}" for i in range(len(self.names))]
        flat = df.toDF(*fields)
        self.df = flat.select(F.struct(*fields).alias("row"), *[F.col(fields[self.place(name)]).alias(alias) for alias, name in needed.items()])

    def place(self, name: str) -> int:
        """Of the column of that name, or else of the first one that differs in case only."""
        if name in self.names:
            return self.names.index(name)
        return [x.lower() for x in self.names].index(name.lower())

    def columns(self, new: dict[str, Column] | None = None, put: dict[str, Column] | None = None) -> list[Column]:
        """All columns as they came, but for those that `put` gives a new value in place, and those named like one of
        `new` in any case, which come last."""
        new, put = new or {}, {self.place(k): v for k, v in (put or {}).items()}
        gone = {x.lower() for x in new}
        kept = [put.get(i, F.col(f"row.c{i}")).alias(x) for i, x in enumerate(self.names) if i in put or x.lower() not in gone]
        return [*kept, *[c.alias(x) for x, c in new.items()]]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of groups, whose rows have different keys and say in `_n` how many of the `total` rows hold them.

    Rows of hot keys (see HOT) are joined by broadcast where they are, so that no task gets all rows of such a key; of
    the others each key has at most one in HOT of all rows, and these are joined by shuffle. Rows without a group go, or
    stay with nulls if how is 'left'.
    """
    hot = groups["_n"] > total // HOT
    others = [c for c in groups.columns if c not in keys]
    some = F.broadcast(groups.where(hot).select(*keys, F.struct(*others).alias("_g")))
    marked = rows.join(some, keys, "left")
    at_once = marked.where("_g is not null").select(*rows.columns, *[F.col(f"_g.`{c}`").alias(c) for c in others])
    return at_once.unionByName(marked.where("_g is null").drop("_g").join(groups.where(~hot), keys, how).select(*rows.columns, *others))


def sieve(hashes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(bitmaps of the hashes in a column, to be broadcast; bits of all of them together): BITS_A_KEY for each hash, up to
    MOST_BITS. hashes is read twice, so it should be a stored table."""
    bits = BITMAP
    while bits < min(MOST_BITS, BITS_A_KEY * hashes.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(name), F.lit(bits))
    maps = hashes.groupBy(F.floor(place / BITMAP).alias("_map")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP))).alias("_bits"))
    return F.broadcast(maps), bits


def marked(rows: DataFrame, name: str, maps: DataFrame, bits: int) -> DataFrame:
    """rows with `_may`: false only if the hash in a column is none of the sieve's. Bits that other hashes have set let some
    through for nothing, few until a sieve has MOST_BITS."""
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(name), F.lit(bits))).withColumn("_map", F.floor(F.col("_place") / BITMAP))
    byte = F.conv(F.hex(F.substring("_bits", F.pmod("_place", F.lit(BITMAP)).cast("int").bitwiseAND(F.lit(BITMAP - 8)) / 8 + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int"))
    return rows.join(maps, "_map", "left").withColumn("_may", F.coalesce(bit == 1, F.lit(False))).drop("_place", "_map", "_bits")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def row_key(id_col: str, text_col: str) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
