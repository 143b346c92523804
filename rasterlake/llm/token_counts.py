"""Edit-aware token counts.

A text is cut into segments where the tokenizer's pre-tokens must part, and a segment tree keeps the characters and tokens
of each segment and of all subtrees. An edit re-encodes the segments it touches, and a neighbour where the cut between
them no longer holds, and updates the sums on the way to the root; the rest of the text is not encoded again.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.common import Carried, bounded_batches, table
from rasterlake.llm.tokens import coder

SEGMENT = 256
#: A pre-token never goes on over a space or newline that follows a character that is not white space.
CUT = re.compile(r"\S[ \n]")
TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDIT = "struct<start:bigint,removed:bigint,inserted:string>"


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Parts of at least `size` characters (but for the last), cut where pre-tokens part."""
    out, at = [], 0
    while len(text) - at > size and (m := CUT.search(text, at + size - 1)) is not None:
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


class Counts:
    """Two heap-ordered trees over the same leaves: node k has the children 2k and 2k + 1, leaves are the second half."""

    def __init__(self, chars, tokens):
        self.chars, self.tokens = np.array(chars, dtype=np.int32), np.array(tokens, dtype=np.int32)
        self.size = len(self.chars) // 2

    @classmethod
    def of(cls, parts: list[str], encode) -> Counts:
        return cls.over([len(p) for p in parts], [encode(p) for p in parts])

    @classmethod
    def over(cls, chars, tokens) -> Counts:
        size = 1 << max(0, len(chars) - 1).bit_length()
        out = cls(np.zeros(2 * size), np.zeros(2 * size))
        for tree, leaves in ((out.chars, chars), (out.tokens, tokens)):
            tree[size : size + len(leaves)] = leaves
            level = size // 2
            while level:
                tree[level : 2 * level] = tree[2 * level : 4 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
        return out

    def leaf(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at place, the place it begins); the last leaf with text for the text's end."""
        place = min(place, int(self.chars[1]) - 1) if self.chars[1] else 0
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, start: int, removed: int, inserted: str, encode) -> tuple[str, int]:
        """(the text after the edit, how many characters were encoded for it)."""
        start = min(max(start, 0), len(text))
        end = min(start + max(removed, 0), len(text))
        a, low = self.leaf(start)
        b, high = self.leaf(max(start, end - 1))
        high += int(self.chars[b + self.size])
        part = text[low:start] + inserted + text[end:high]
        while low > 0 and part[:1] not in (" ", "\n"):
            a, begin = self.leaf(low - 1)
            part, low = text[begin:low] + part, begin
        while high < len(text) and (not part or part[-1].isspace()):
            b, begin = self.leaf(high)
            part, high = part + text[high : begin + int(self.chars[b + self.size])], begin + int(self.chars[b + self.size])
        text = text[:low] + part + text[high:]
        slots = b - a + 1
        parts = segments(part, max(SEGMENT, len(part) // slots + 1))
        counts = [encode(p) for p in parts]
        if len(part) > 4 * SEGMENT * slots:  # too much new text for these leaves: a new tree over all segments
            parts = segments(part)
            counts = [encode(p) for p in parts]
            old = slice(self.size, self.size + a), slice(self.size + b + 1, 2 * self.size)
            new = Counts.over(*([*tree[old[0]], *own, *tree[old[1]]] for tree, own in ((self.chars, [len(p) for p in parts]), (self.tokens, counts))))
            self.chars, self.tokens, self.size = new.chars, new.tokens, new.size
        else:
            for k in range(slots):
                self.put(a + k, *((len(parts[k]), counts[k]) if k < len(parts) else (0, 0)))
        return text, len(part)


def whole(n) -> int:
    """A number as pandas gives it; 0 for null."""
    return 0 if n is None or n != n else int(n)


def counter(path: str):
    ids = coder(path).whole
    return lambda text: len(ids(text)) // 2 if text else 0


def count_trees(texts: Column, path: str) -> Column:
    """The tree of each text; null for null."""

    @F.pandas_udf(TREE)
    def run(s: pd.Series) -> pd.DataFrame:
        encode = counter(path)
        trees = [None if t is None else Counts.of(segments(t), encode) for t in s]
        return pd.DataFrame({k: [None if t is None else getattr(t, k) for t in trees] for k in ("chars", "tokens")})

    return run(texts)


def edited(texts: Column, trees: Column, edits: Column, path: str) -> Column:
    """(text, tree, encoded) after a text's edits in turn; encoded counts the characters that went through the tokenizer."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("tree", TREE), T.StructField("encoded", T.LongType())])

    @F.pandas_udf(kind)
    def run(s: pd.Series, tree: pd.DataFrame, changes: pd.Series) -> pd.DataFrame:
        encode, out = counter(path), []
        for text, chars, tokens, todo in zip(s, tree["chars"], tree["tokens"], changes, strict=True):
            if text is None:
                out.append((None, None, 0))
                continue
            counts, encoded = Counts(chars, tokens), 0
            for e in todo if todo is not None else ():
                text, n = counts.edit(text, whole(e["start"]), whole(e["removed"]), e["inserted"] or "", encode)
                encoded += n
            out.append((text, {"chars": counts.chars, "tokens": counts.tokens}, encoded))
        return pd.DataFrame(out, columns=["text", "tree", "encoded"])

    return run(texts, trees, edits)


def build_counts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with tree, the counts of text_col.

    - a null text has a null tree, an empty one a single leaf without tokens. Texts of any length are counted whole.
    - repeated rows get the same tree; a column named tree, in any case, is replaced; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    own = Carried(docs, text=text_col)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return own.df.select("row", count_trees(F.col("text"), path).alias("tree")).select(*own.columns({"tree": F.col("tree")}))


def apply_edits(counted: DataFrame, edits_col: str = "edits", vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """counted (of build_counts) with text_col and tree as they are after the row's edits, and encoded.

    edits_col is an array of (start, removed, inserted) in code points, applied one after the other; starts and ends are
    moved into the text, null fields are 0 or ''. A null array leaves the row as it is; so does a null text, which has no
    characters to edit. Repeated rows are edited each on their own; other columns pass through, but for one named encoded,
    in any case, which is replaced; empty tables stay empty.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = Carried(counted, text=text_col, tree="tree", edits=edits_col)
    out = own.df.select("row", edited(F.col("text"), F.col("tree"), F.col("edits"), path).alias("e"))
    kept = [c for i, c in enumerate(own.columns(put={text_col: F.col("e.text"), "tree": F.col("e.tree")})) if i != own.place(edits_col) and own.names[i].lower() != "encoded"]
    return out.select(*kept, F.col("e.encoded").alias("encoded"))


def join_edits(counted: DataFrame, edits: DataFrame, id_col: str = "doc_id", first: int | None = None, last: int | None = None) -> DataFrame:
    """counted with the array edits of the rows (id_col, seq, start, removed, inserted), by seq from `first` to `last`.

    A document's edits come together as one array, as they must be applied in turn; a long log is joined and applied in
    batches of seq. Edits of one seq are ordered by their other columns.

    - rows without edits, and rows with a null id, get a null array; edits with a null id are left out.
    - repeated rows of counted get the same edits each; repeated edits are applied each.
    - a column of counted named edits, in any case, is replaced. Empty tables give no rows, or null arrays.
    """
    change = F.struct(F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), F.col("inserted").cast("string").alias("inserted"))
    log = Carried(edits, id=id_col, seq="seq", start="start", removed="removed", inserted="inserted").df.where("id is not null")
    if first is not None:
        log = log.where(F.col("seq") >= first)
    if last is not None:
        log = log.where(F.col("seq") <= last)
    e = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", change.alias("e")))).alias("edits")).select(F.col("id").alias("edited"), F.col("edits.e").alias("edits"))
    own = Carried(counted, id=id_col)
    return own.df.join(e, F.col("id") == F.col("edited"), "left").select(*own.columns({"edits": F.col("edits")}))


def total(tree: str) -> Column:
    """A tree's tokens."""
    return F.col(f"{tree}.tokens")[1].cast("long")


def sample_edits(text: str) -> Column:
    """Three edits of any text: five characters in its middle replaced, its first ten removed, a line added at its end."""
    change = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    n = F.length(text)
    return F.array(change(F.floor(n / 2), 5, " or 42 new words"), change(F.lit(0), 10, ""), change(n + 100, 0, "\nThe end."))


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = build_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    before = counted.withColumns({"tokens_before": total("tree"), "chars_before": F.length("text").cast("long"), "edits": sample_edits("text")})
    out = apply_edits(before)
    return out.select("doc_id", "tokens_before", total("tree").alias("tokens_after"), "chars_before", F.length("text").cast("long").alias("chars_after"), F.col("encoded").alias("chars_encoded"))
