from itertools import combinations

import numpy as np
import pytest

from rasterlake.llm import toxicity
from rasterlake.llm.langid import fold


def brute_kernel(s, t, d=toxicity.DECAY, gap=toxicity.GAP):
    near = lambda a: a[1] - a[0] <= gap and a[2] - a[1] <= gap
    return sum(d ** (a[2] - a[0] + 1 + b[2] - b[0] + 1) for a in combinations(range(len(s)), 3) for b in combinations(range(len(t)), 3) if near(a) and near(b) and [s[i] for i in a] == [t[j] for j in b])


def brute_own(n):
    return brute_kernel([*range(n)], [*range(n)])


@pytest.mark.parametrize("pair", [("idiot", "idxiot"), ("stupid", "stupidly"), ("abc", "abc"), ("ab", "ab"), ("aaaa", "aaa"), ("^loweiß", "loweischaft"), ("^abc", "^xabc")])
def test_kernel_against_subsequences(pair):
    marks = toxicity.Landmarks([pair[0], "padding"])
    assert marks.sums(toxicity.Landmarks.codes([pair[1]])[0])[0, 0] == pytest.approx(brute_kernel(*pair), rel=1e-5)
    assert marks.own[0] == pytest.approx(brute_own(len(pair[0])), rel=1e-5)


def test_gram_is_a_kernel_matrix():
    gram = toxicity.Landmarks("^idiot ^idiots idio ^stupid upid ^trash worthless ^less aaaa ^aa".split()).gram
    assert np.allclose(gram, gram.T) and np.linalg.eigvalsh(gram).min() > -1e-6


def plain_parts(text):
    """Parts of words, with a ^ before those that begin one."""
    import string

    words = "".join(c for c in (text or "") if c not in string.punctuation).lower().split()
    out, run = list(words), []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
    return [("^" if i == 0 else "") + w[i : i + 24] for w in out for i in range(0, max(len(w) - 12, 1), 12)]


PARTS = [None, " .. ", "You I-d*I.o_t!", "an i d i o t here", "a b", "a b c", "x y. z w", "x" * 24, "x" * 25, "abcdefghijklmnopqrstuvwxyz" * 3, "É ÀB\u2003ß\x1cc d e\nf 𝒳yz"]


def parts_as_text(texts):
    p = toxicity.parts_of(texts)
    return [sorted(("^" if p.begins[i] else "") + "".join(map(chr, p.points[p.first[i] : p.first[i] + p.size[i]])) for i in np.flatnonzero(p.text == k)) for k in range(len(texts))]


def test_parts_of_words():
    assert parts_as_text(PARTS) == [sorted(plain_parts(t)) for t in PARTS]
    assert [parts_as_text([t])[0] for t in PARTS] == parts_as_text(PARTS)
    p = toxicity.parts_of(["one two one", "two One"])
    one, which = p.different()
    assert len(one) == 2 and which[0] == which[2] == which[4] and which[1] == which[3]


def plain_score(model, text):
    parts, n = plain_parts(text), len(model.marks)
    x = np.zeros(2 * n)
    for k, m in enumerate(model.marks):
        alike = [min(brute_kernel(m, w) / brute_own(len(m)), 1) for w in parts]
        x[k] = max(alike, default=0) ** 2
        x[n + k] = np.log1p(100 * sum(v**8 for v in alike) / (len(parts) + 20))
    return 1 / (1 + np.exp(-(model.slope * (x @ model.weights + model.bias) + model.shift)))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(0)
    clean = "tree house river stone garden window summer letter music paper bridge table orange winter".split()
    bad = ["blockhead", "numbskull", "nitwit"]
    rows = []
    for i in range(600):
        words = list(rng.choice(clean, 30))
        if i % 6 == 0:
            for _ in range(3):
                words[rng.integers(30)] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_gapped_insults(spark, model):
    rows = [(1, "the river and a blockhead nitwit"), (2, "the river and a b-l-o-c-k-h-e-a-d n1twit"), (3, "the river and a bxlockxhead nitxwit numbbskull"), (4, "the river and a house with a garden"), (5, None), (6, ""), (7, "... !!"), (8, "tree " * 200_000), (8, "tree " * 200_000), (None, "nitwit blockhead")]
    df = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, toxicity int")
    out = toxicity.score_toxicity(df, model)
    assert out.columns == ["doc_id", "text", "toxicity"] and dict(out.dtypes)["toxicity"] == "double"
    score = {(r.doc_id, i): r.toxicity for i, r in enumerate(out.collect())}
    assert all(0 <= s <= 1 for s in score.values())
    assert {k[0] for k, s in score.items() if s >= 0.5} == {1, 2, 3, None}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_scores_against_plain_python(spark, model):
    texts = ["a nitwit and a bxlockxhead", "the garden n i t w i t", "numbskullnumbskullnumbskull river", None, "", "river " * 50 + "nitwits"]
    df = spark.createDataFrame(list(enumerate(texts)), "Doc_id long, TEXT string")
    got = {r.Doc_id: r.toxicity for r in toxicity.score_toxicity(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, t), abs=1e-4)


def test_slices_of_texts(monkeypatch, model):
    texts = ["river nitwit " * k for k in range(40)]
    whole = toxicity.Landmarks(model.marks).likeness(texts)
    monkeypatch.setattr(toxicity, "SLICE", 50)
    monkeypatch.setattr(toxicity, "CHUNK", 2)
    assert np.allclose(toxicity.Landmarks(model.marks).likeness(texts), whole, atol=1e-5)


def test_clashing_names(spark, model):
    df = spark.createDataFrame([("nitwit blockhead", 1, 2, 3, 4, "x")], "text string, Toxicity int, row int, p int, __d int, TEXT string")
    out = toxicity.score_toxicity(df, model)
    assert out.columns == ["text", "row", "p", "__d", "TEXT", "toxicity"] and out.first()["toxicity"] > 0.5


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for rows, positive in (([], None), ([(1, 0)], False), ([(1, 1)], True), ([(1, None)], None)):
        m = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        s = {r.toxicity for r in toxicity.score_toxicity(docs, m).collect()}
        assert len(s) == 1 and (positive is None or (s.pop() > 0.5) == positive)


def test_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op1_subsequence_svm(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    s, t = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert (s[t == 1][:, None] > s[t == 0][None, :]).mean() > 0.8 and ((s >= 0.5) == t).mean() > 0.93
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == docs.count() and out.where("held_out").count() == docs.where(fold(5) == 0).count()
    assert all(r.predicted == (r.score >= 0.5) for r in out.collect())


def test_landmarks_of_many_letters(monkeypatch):
    import tracemalloc

    marks = ["".join(chr(0x4E00 + 12 * k + i) for i in range(12)) for k in range(64)]
    tracemalloc.start()
    wide = toxicity.Landmarks(marks)
    codes, own = toxicity.Landmarks.codes(marks)
    k = wide.kernels(codes)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    assert np.allclose(np.diag(k), 1) and wide.table is None
    few = toxicity.Landmarks(["grible", "snurf", "plonker"])
    words, _ = toxicity.Landmarks.codes(["gribbble", "snorf", "xyz", "^plonk"])
    by_table = few.kernels(words)
    monkeypatch.setattr(toxicity, "DENSE", 0)
    assert np.array_equal(toxicity.Landmarks(["grible", "snurf", "plonker"]).kernels(words), by_table)
