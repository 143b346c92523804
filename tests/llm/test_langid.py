import re
from collections import Counter

import numpy as np

from rasterlake.llm import langid


def counts(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out.update(w)
        p = f" {w} "
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def decode(gram):
    return "".join(chr(x) for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


def test_grams_against_plain_counts(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 50)
    texts = ["Hello, wörld! a 1b", "", "xyz " * 40, "中文 test 𝒳y", "a" * 20 + " b"]
    g, gram, n = langid.grams(texts, np.arange(len(texts)))
    got = {}
    for i, x, c in zip(g.tolist(), gram.tolist(), n.tolist(), strict=True):
        got.setdefault(i, Counter())[decode(x)] = c
    assert got == {i: counts(t) for i, t in enumerate(texts) if counts(t)}


def test_distance_against_plain():
    profile = [[langid.grams(["the then that"], np.zeros(1, dtype=np.int64))[1][i] for i in (0, 3, 5, 7)]]
    text = "the thing is that"
    own = sorted(counts(text).items(), key=lambda x: (-x[1], [ord(c) for c in x[0]] + [0] * (3 - len(x[0]))))[:10]
    place = {decode(int(x)): i for i, x in enumerate(profile[0])}
    want = sum(abs(place[x] - i) if x in place else 10 for i, (x, _) in enumerate(own)) / len(own) / 10
    assert abs(langid.distances([text], profile, 10)[0, 0] - want) < 1e-12


def test_edges(spark):
    rows = [(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und der vogel", "de"), (3, None, "en"), (4, "12 34 !", "en"), (5, "", None), (6, "und der hund", None), (6, "und der hund", None), (None, "the bird", None), (8, "the dog " * 300_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    profiles = langid.learn_profiles(df.where("doc_id < 3"))
    assert sorted(profiles) == ["de", "en"]
    out = langid.predict_language(df, profiles)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out.collect()) == [(0, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de"), (8, "en")]
    assert {r.score for r in out.where("lang_pred = 'und'").collect()} == {0.0}
    assert langid.learn_profiles(df.limit(0)) == {} and langid.predict_language(df.limit(0), profiles).count() == 0
    assert {r.lang_pred for r in langid.predict_language(df, {}).collect()} == {"und"}


def test_clashing_names(spark):
    profiles = langid.learn_profiles(spark.createDataFrame([("the cat and the dog", "en", 1)], "text string, lang string, TEXT int"))
    df = spark.createDataFrame([("the dog", 1, 2, 3, "x")], "text string, Score int, __guess int, row int, Text string")
    out = langid.predict_language(df, profiles)
    assert out.columns == ["text", "__guess", "row", "Text", "lang_pred", "score"] and tuple(out.first())[:5] == ("the dog", 2, 3, "x", "en")


def test_a_long_word_is_not_cut(monkeypatch):
    text = "ab" * 50 + "cd 1 " + "xyz" * 30
    whole = langid.grams([text], np.zeros(1, dtype=np.int64))
    monkeypatch.setattr(langid, "SLICE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(langid.grams([text], np.zeros(1, dtype=np.int64)), whole, strict=True))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = langid.op2_language_profiles(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
