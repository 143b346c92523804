import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterlake.llm import packing, tokens


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_give_the_tokenizers_ids(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b", " a", "a ", "a\n\nb", "it's we'll", "x\x1cy z", "　a b", "a\xa0b c", "<|endoftext|> a", "中文 字 1234 5", "tab\there x", "é" * 70 + " b"]
    code, ref = tokens.coder(public_tokenizers.path("byte_bpe_50k.tiktoken")), reference()
    for t, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.ids_of(code.whole(t)).tolist() == e.ids


def test_special_token_is_one_id(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x \n<|endoftext|>\n\n y", "<|endoftext|", "two  blanks <|endoftext|>  and more", "<|<|endoftext|>endoftext|>"]
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {p.doc_id: tokens.ids_of(bytes(p.ids)).tolist() for p in packing.pack(df, 1 << 12).collect()}
    assert got == {i: [*ref.encode(t, add_special_tokens=False).ids, tokens.END] for i, t in enumerate(texts)}


def test_hilbert_steps_are_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check(rows, pieces, length):
    ref = reference()
    want = {}
    for i, t in rows:
        ids = np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(i, []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for i, ps in got.items():
        assert sum(p.length for p in ps) == sum(map(len, want[i]))
        for p in ps:
            ids = next(x for x in want[i] if len(x) == p.doc_tokens)
            part = ids[p.start : p.start + p.length]
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and tokens.ids_of(bytes(p.ids)).tolist() == part.tolist()
    at, used = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0) and p.length > 0
        at[p.sequence_id] = p.offset + p.length
    used = [at[k] for k in sorted(at)]
    assert sorted(at) == list(range(len(at))) and all(n == length for n in used[:-1]) and 0 < used[-1] <= length


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (3, "other words for the same id"), (None, "no id"), (4, "long " * 3000), (5, "an end <|endoftext|> in it " * 30), *[(10 + i, "one and the same text") for i in range(40)]]
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id long, text string, start int, other string, Row int").toDF("doc_id", "text", "start", "DOC_ID", "Row")
    check(rows, packing.pack(df, 64).collect(), 64)
    assert packing.pack(df.limit(0)).count() == 0


def test_query_and_neighbours(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs).collect()
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], pieces, 1024)
    assert packing.op4_hilbert_packing(spark, sf_dir).count() == len(pieces)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    same = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:], strict=False)])
    share = np.array([*np.unique([*lang.values()], return_counts=True)[1]]) / len(lang)
    assert same > (share**2).sum() + 0.15  # neighbours share a language more often than by chance
