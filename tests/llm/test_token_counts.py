import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlake.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
REF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = ["<|endoftext|>", "<|endof", "text|>", "a", "the ", " ", "\n", "  ", "it's ", "é", "1", "42", "\t", "\x1c", "\xa0", ".", "!", "中", "Hello ", "x y\n"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=120).map("".join)


def count(text):
    return len(REF.encode(text, add_special_tokens=False).ids)


@given(TEXT, st.lists(st.tuples(st.integers(-3, 300), st.integers(-1, 80), st.lists(st.sampled_from(PIECES), max_size=80).map("".join)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_edits_against_whole_recount(text, edits):
    old, tc.SEGMENT = tc.SEGMENT, 16
    try:
        encode = tc.counter(PATH)
        tree = tc.Counts.of(tc.segments(text, 16), encode)
        assert tree.tokens[1] == count(text)
        for start, removed, inserted in edits:
            a = min(max(start, 0), len(text))
            want = text[:a] + inserted + text[min(a + max(removed, 0), len(text)) :]
            text, _ = tree.edit(text, start, removed, inserted, encode)
            assert text == want and tree.tokens[1] == count(text) and tree.chars[1] == len(text)
            for k in range(1, tree.size):
                assert tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1]
    finally:
        tc.SEGMENT = old


def test_special_token_counts_once():
    ref, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tc.counter(PATH)
    count = lambda t: len(ref.encode(t, add_special_tokens=False).ids)
    text = "some words <|endoftext|> of a text\n<|endof x text|> " * 60
    tree = tc.Counts.of(tc.segments(text), encode)
    assert tree.tokens[1] == count(text)
    for start, removed, inserted in ((15, 1, ""), (15, 0, "n"), (text.index("f x t") + 1, 3, ""), (700, 0, "<|endoftext|>"), (0, 400, "")):
        text, _ = tree.edit(text, start, removed, inserted, encode)
        assert tree.tokens[1] == count(text)


def test_little_is_encoded_again():
    text = "some words of a text " * 5000
    encode = tc.counter(PATH)
    tree = tc.Counts.of(tc.segments(text), encode)
    _, n = tree.edit(text, 50_000, 3, "other", encode)
    assert n < 4 * tc.SEGMENT


def test_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", 9), (1, "some words here", 9), (2, None, 9), (3, "", 9), (None, "no id", 9)], "doc_id long, text string, encoded int")
    counted = tc.build_counts(docs)
    edits = spark.createDataFrame([(1, 2, 0, 4, "many"), (1, 1, 5, 0, "new "), (3, 1, 7, 2, "text"), (2, 1, 0, 0, "x"), (3, 2, None, None, None)], "doc_id long, seq int, start long, removed long, inserted string")
    out = tc.apply_edits(tc.join_edits(counted, edits)).select("doc_id", "text", tc.total("tree").alias("n")).collect()
    want = [(1, "many new words here"), (1, "many new words here"), (2, None), (3, "text"), (None, "no id")]
    assert sorted(((r.doc_id, r.text, r.n) for r in out), key=repr) == sorted(((i, t, None if t is None else count(t)) for i, t in want), key=repr)
    assert tc.apply_edits(tc.join_edits(counted.limit(0), edits)).count() == 0


def test_clashing_names_and_batches(spark):
    docs = spark.createDataFrame([(1, "some words here", 9, 8, 7)], "doc_id long, text string, Tree int, e int, EDITS int")
    counted = tc.build_counts(docs)
    assert counted.columns == ["doc_id", "text", "e", "EDITS", "tree"]
    log = spark.createDataFrame([(1, 1, 0, 4, "many", "x"), (1, 2, 5, 0, "new ", "y")], "doc_id long, seq int, start long, removed long, inserted string, Doc_Id string")
    for first, last in ((1, 1), (2, 9)):
        joined = tc.join_edits(counted, log, first=first, last=last)
        assert joined.columns[-1] == "edits" and "EDITS" not in joined.columns
        counted = tc.apply_edits(joined)
    assert counted.columns == ["doc_id", "text", "e", "tree", "encoded"]
    row = counted.select("text", "e", tc.total("tree").alias("n")).first()
    assert tuple(row) == ("many new words here", 8, count("many new words here"))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in tc.op5_edit_aware_counts(spark, sf_dir).collect():
        t = texts[r.doc_id]
        h = len(t) // 2
        new = (t[:h] + " or 42 new words" + t[h + 5 :])[10:] + "\nThe end."
        assert (r.tokens_before, r.tokens_after, r.chars_after) == (count(t), count(new), len(new))
