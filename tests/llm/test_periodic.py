import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from rasterlake.llm import periodic


def brute(words):
    """Every run of the words, by trying each start and period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a\x0ba a\x0ca a a y", "a b a b a b a b", "a b a b a b a", "a b " * 50, "é è " * 9 + "\xa0 z", "a a a a a a b b b b b b", "ab " * 3000, "a b c d e f g " * 500]
    for size, letters in ((40, 2), (60, 2), (200, 2), (200, 3), (300, 4)):
        out += [" ".join(rng.choice("abcd"[:letters]) for _ in range(size)) for _ in range(12)]
    for _ in range(40):  # periodic stretches in other text, some with one word changed
        own = [str(rng.randrange(6)) for _ in range(rng.randrange(30))]
        for _ in range(3):
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
            own += (block * 9)[: rng.randrange(len(block), 9 * len(block))] + [str(rng.randrange(6)) for _ in range(rng.randrange(4))]
        if rng.random() < 0.5 and own:
            own[rng.randrange(len(own))] = "z"
        out.append(" ".join(own))
    return out


def split(text):
    return (text or "").encode().split()


def test_against_brute_force_and_edges(spark):
    rows = [(k, t, k, "old") for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, _found long, RUNS string").repartition(3)
    out = periodic.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "_found", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w.decode() for w in split(r.text)]
        want = brute(words)
        assert [tuple(x) for x in r.runs] == want, r.text
        assert r.collapsed == collapsed(words, want) and r._found == r.doc_id
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_few_pairs_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 2, 400), np.tile(rng.integers(0, 3, 37), 6), [-1], np.zeros(100, dtype=np.int64)])
    want = [tuple(map(int, r)) for r in zip(*periodic.runs_of(words), strict=True)]
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert want == [tuple(map(int, r)) for r in zip(*periodic.runs_of(words), strict=True)] and len(want) > 10


def test_long_texts():
    same = np.zeros(1_000_000, dtype=np.int64)
    assert [tuple(map(int, r)) for r in zip(*periodic.runs_of(same), strict=True)] == [(0, 1_000_000, 1)]
    far = np.concatenate([[-1], np.tile(np.random.default_rng(0).permutation(100_000), 5)[:450_000]])
    assert [tuple(map(int, r)) for r in zip(*periodic.runs_of(far), strict=True)] == [(1, 450_000, 100_000)]


def expected(doc_id, text):
    words = [w.decode() for w in split(text)]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(collapsed(words, runs)))


def test_query(spark, sf_dir, tmp_path):
    own = spark.createDataFrame([(k, t) for k, t in enumerate(texts())] + [(None, "a " * 8)] + [(k, "one two three four five six seven eight") for k in range(1000, 1060)], "doc_id long, text string")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    for path in (str(tmp_path), f"{tmp_path}/b"):
        rows = spark.read.parquet(f"{path}/documents.parquet").collect()
        out = periodic.op13_periodic_runs(spark, path)
        assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in out.collect()) > 10
