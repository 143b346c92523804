"""Entropy coding as tables: the symbols of JPEG's blocks, optimal prefix codes of bounded length, and bit streams.

Symbols are rows; their counts are aggregates. A group of counts, of at most a few hundred symbols, becomes codes in its row.
Where a code's bits go is a running sum of lengths, and a byte is the sum of the bits that fall into it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made

#: JPEG's symbols for sixteen zeros and for a block's end; the longest code.
ZEROS, END, LONGEST = 0xF0, 0, 16


def up(v: Column, n: Column) -> Column:
    """v shifted by a number of bits that is a column."""
    return F.call_function("shiftleft", v, n)


def down(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n)


def bit_size(v: Column) -> Column:
    """The bits that a number's size takes, 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def jpeg_symbols(blocks: DataFrame) -> DataFrame:
    """image_id, frame_idx, n, k, ac, symbol, value, size: what a baseline coder sends for blocks (image_id, frame_idx, n, q), whose q
    are 64 quantised numbers in zig-zag order, in the order of n and k.

    The first number is sent as its difference to the block before, the others as runs of zeros and a number; sixteen zeros
    and the end of a block are symbols of their own. value holds the `size` bits that follow the symbol's code. The only
    window is over the first numbers of one frame.
    """
    q = F.col("q")
    entry = lambda k, ac, symbol, v: F.struct(k.cast("int").alias("k"), F.lit(ac).alias("ac"), symbol.cast("int").alias("symbol"), F.when(v < 0, v - 1 + up(F.lit(1), bit_size(v))).otherwise(v).cast("int").alias("value"), bit_size(v).alias("size"))
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda k: q[k] != 0)
    before = F.lag("__dc", 1, 0).over(Window.partitionBy("image_id", "frame_idx").orderBy("n"))
    known = blocks.select("image_id", "frame_idx", "n", "q", made(__at=places, __dc=q[0]))
    known = known.withColumn("__t", F.col("__dc") - before)

    def sent(k: Column, j: Column) -> Column:
        run = k - F.coalesce(F.get(F.col("__at"), j - 1), F.lit(0)) - 1
        full = F.floor(run / 16).cast("int")
        zeros = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < full), lambda i: entry(k - run + i * 16 + 15, True, F.lit(ZEROS), F.lit(0)))
        return F.concat(zeros, F.array(entry(k, True, run % 16 * 16 + bit_size(q[k]), q[k])))

    last = F.coalesce(F.get(F.col("__at"), F.size("__at") - 1), F.lit(0))
    first = F.array(entry(F.lit(0), False, bit_size(F.col("__t")), F.col("__t")))
    end = F.filter(F.array(entry(F.lit(64), True, F.lit(END), F.lit(0))), lambda _: last < 63)
    each = known.select("image_id", "frame_idx", "n", F.explode(F.concat(first, F.flatten(F.transform("__at", sent)), end)).alias("s"))
    return each.select("image_id", "frame_idx", "n", "s.*")


def limited_lengths(counts: list[int], longest: int) -> np.ndarray:
    """The lengths of an optimal prefix code whose codes have at most `longest` bits, by package-merge: `longest` times over, the
    items by weight are merged with the last round's packages of two, and the 2 (n - 1) lightest of the last round tell how
    often each item is taken. Of equal weights the item goes first, of items the earlier one. Two or more items."""
    n = len(counts)
    order = np.argsort(np.array(counts), kind="stable")
    items = [(counts[k], np.eye(1, n, k, dtype=np.int64)[0]) for k in order]
    merged = items
    for _ in range(longest - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)]
        merged = sorted(items + packages, key=lambda x: x[0])
    return sum(x[1] for x in merged[: 2 * (n - 1)])


def canonical(counts: list[int], longest: int, reserve: bool) -> tuple[np.ndarray, list[int]]:
    """(lengths, codes). Codes go by length, then by falling count, then by place. With reserve the code of ones alone stays free."""
    weights = [*counts, 0] if reserve else counts
    if len(weights) > 1 << longest:
        raise ValueError(f"{len(counts)} symbols do not have codes of {longest} bits")
    lengths = limited_lengths(weights, longest)[: len(counts)] if len(weights) > 1 else np.ones(1, dtype=np.int64)
    if reserve and len(counts) and (longest_one := limited_lengths(weights, longest))[-1] < longest_one.max():
        raise AssertionError("an item of weight nothing has a code of the greatest length")
    codes, code, size = [0] * len(counts), 0, 0
    for k in sorted(range(len(counts)), key=lambda k: (lengths[k], -counts[k], k)):
        code <<= int(lengths[k]) - size
        codes[k], size = code, int(lengths[k])
        code += 1
    return lengths, codes


def prefix_codes(counts: DataFrame, keys: list[str], longest: int = LONGEST, reserve: bool = True) -> DataFrame:
    """keys, symbol, n, length, code of counts (keys, symbol, n): for each group the prefix code of least n * length in all, of at most
    `longest` bits, in canonical form.

    Symbols that do not occur (n null or not above 0) have no code; a symbol that is there twice counts once, with both n.
    With reserve (as JPEG wants it) no code is all ones. A group of one symbol has a code of one bit. A group is one array, so
    it should not have more than some thousand symbols.
    """

    def run(groups: pa.Array) -> pa.Array:
        lengths, codes, ends = [], [], [0]
        for own in groups.to_pylist():
            made_lengths, made_codes = canonical(own, longest, reserve)
            lengths += made_lengths.tolist()
            codes += made_codes
            ends.append(len(codes))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.array(codes, pa.int64())], ["length", "code"]))

    one = counts.where("n > 0").groupBy(*keys, "symbol").agg(F.sum("n").alias("n"))
    groups = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("symbol", "n"))).alias("__s"))
    coded = groups.withColumn("__c", F.arrow_udf(run, "array<struct<length: int, code: bigint>>")(F.transform("__s", lambda s: s["n"])))
    each = coded.select(*keys, F.explode(F.arrays_zip("__s", "__c")).alias("z"))
    return each.select(*keys, "z.__s.symbol", "z.__s.n", "z.__c.length", "z.__c.code")


def bit_streams(codes: DataFrame, keys: list[str], order: list[str], stuff: bool = True) -> DataFrame:
    """keys, n_bits, content: the codes (keys, order, code, length) of each group one after the other, the first bit highest; the last
    byte is filled up with ones. With stuff a byte of ones is followed by zeros, as JPEG wants it.

    Codes of length null or 0 have no bits; only the last `length` bits of a code count, up to 48. The order must tell the codes of a
    group apart. Windows and groups are those of one image; its bytes are gathered in pages of 4,096 first.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    c = codes.where("length > 0").select(*keys, *order, F.col("length").cast("int").alias("__size"), (F.col("code").cast("long").bitwiseAND(up(F.lit(1).cast("long"), F.col("length").cast("int")) - 1)).alias("__code"))
    c = c.withColumns({"__end": F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, 0)), "__last": F.lead("__size").over(own).isNull()})
    fill = F.when(F.col("__last"), F.pmod(-F.col("__end"), F.lit(8))).otherwise(0).cast("int")
    filled = c.select(*keys, "__last", "__end", made(__stop=F.col("__end") + fill, __bits=F.col("__size") + fill, __value=up(F.col("__code"), fill) + up(F.lit(1).cast("long"), fill) - 1))
    first, last = F.floor((F.col("__stop") - F.col("__bits")) / 8), F.floor((F.col("__stop") - 1) / 8)
    pieces = filled.withColumn("__b", F.explode(F.sequence(first, last)))
    by = (F.col("__b") * 8 + 8 - F.col("__stop")).cast("int")
    piece = F.when(by >= 0, up(F.col("__value"), by)).otherwise(down(F.col("__value"), -by)).bitwiseAND(F.lit(255).cast("long"))
    n_bits = F.max(F.when(F.col("__last"), F.col("__end"))).alias("__n")
    each = pieces.groupBy(*keys, "__b").agg(F.sum(piece).alias("__v"), n_bits)
    byte = F.lpad(F.hex("__v"), 2, "0")
    shown = F.when(F.col("__v") == 255, "FF00").otherwise(byte) if stuff else byte
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__h"))), lambda x: x["__h"]), "").alias("__h")
    pages = each.withColumn("__h", shown).groupBy(*keys, F.floor(F.col("__b") / 4096).alias("__p")).agg(text("__b"), F.max("__n").alias("__n"))
    whole = pages.groupBy(*keys).agg(text("__p"), F.max("__n").alias("__n"))
    return whole.select(*keys, F.col("__n").alias("n_bits"), F.unhex("__h").alias("content"))


def baseline_scans(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans: image_id, frame_idx, n_bits, content; codes: image_id, frame_idx, ac, symbol, n, length, code) of quantised blocks of one
    component: their symbols, the best codes for those of each frame, and the bits of both, stuffed."""
    symbols = jpeg_symbols(blocks)
    key = ["image_id", "frame_idx"]
    codes = prefix_codes(symbols.groupBy(*key, "ac", "symbol").agg(F.count(F.lit(1)).alias("n")), [*key, "ac"])
    sent = symbols.join(codes.drop("n"), [*key, "ac", "symbol"])
    whole = up(F.col("code"), F.col("size")) + F.col("value")
    return bit_streams(sent.select(*key, "n", "k", whole.alias("code"), (F.col("length") + F.col("size")).alias("length")), key, ["n", "k"]), codes
