import hashlib
import math

import numpy as np
import pytest
from conftest import same_rows

from rasterlake.llm import vector_codes


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, entries=16, rounds=6):
    """(books, (id, label, code, error) of each kept row) in Python's integers, trying every entry."""
    kept = sorted(((i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if sound(v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 8 if kept else 1
    parts = [[v[k * width : k * width + width] for k in range(8)] for _, _, v in kept]
    books = [[p[k] for p in parts[:entries]] for k in range(8)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            own = [near(p[k], book)[1] for p in parts]
            for j in range(len(book)):
                mine = [p[k] for p, o in zip(parts, own, strict=True) if o == j]
                if mine:
                    book[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (i, label, _), p in zip(kept, parts, strict=True):
        found = [near(p[k], books[k]) for k in range(8)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return books, out


def test_nearest_entry_and_ties():
    rng = np.random.default_rng(0)
    for entries in (1, 2, 3, 16, 100):
        for wide in (2, 50):
            book = rng.integers(-wide, wide, (entries, 4))
            book[entries // 2 :] = book[: entries - entries // 2]  # equal entries
            x = rng.integers(-2 * wide, 2 * wide, (2000, 4))
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            index, best = vector_codes.Tree.of(book).nearest(x)
            assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    most = vector_codes.largest(64)
    ends = np.array([[most] * 8, [-most] * 8])
    assert vector_codes.Tree.of(ends[:1]).nearest(ends)[1].tolist() == [0, 8 * (2 * most) ** 2]


def edges():
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-3, 4, 16).astype(float).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(200) + 50]  # small integers: many ties
    rows += [(i, [0.1 * i - 1.05] * 16, 7) for i in range(20)]
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [], 1), (905, [-0.0] * 16, 9), (None, [0.3] * 16, None)]
    return rows + rows[:5]


@pytest.mark.parametrize("entries", [16, 5])
def test_against_brute_force_and_edges(spark, entries):
    rows = edges()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, CODE string, _v int").repartition(4)
    want_books, want = brute(rows, entries)
    books = vector_codes.learn_codebooks(df, entries)
    assert books.tolist() == want_books
    out = vector_codes.with_label_errors(vector_codes.encode(df, books))
    assert out.columns == ["vec_id", "embedding", "label", "_v", "code", "error", "label_error"]
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()), key=repr) == sorted(((*w, sums[w[1]]) for w in want), key=repr)
    back = vector_codes.encode(df, books).withColumn("d", vector_codes.decoded("code", books)).where("vec_id < 900").collect()
    for r in back:
        v = [math.floor(4096 * x) for x in r.embedding]
        assert sum((a - int(b * 4096)) ** 2 for a, b in zip(v, r.d, strict=True)) == r.error


def test_few_odd_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)], [(1, [float(x) for x in range(8)], 2)], [(3, [1e30] * 8, 0), (4, [0.5] * 8, 0), (5, [0.5] * 16, 0), (6, [0.5] * 7, 0)]):
        df = spark.createDataFrame(rows, schema)
        books = vector_codes.learn_codebooks(df)
        got = vector_codes.with_label_errors(vector_codes.encode(df, books)).collect()
        assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(r[0], "00" * 8, 0, 0) for r in rows if r[1] and len(r[1]) == 8 and r[1][0] < 9]


def test_query(spark, sf_dir, duck, tmp_path):
    out = vector_codes.op12_vector_codes(spark, sf_dir)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same_rows(out, duck, vector_codes.ORACLE_SQL)
    rows = edges()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    books, want = brute(rows)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(tuple, vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()), key=repr) == sorted(((i, code, error, sums[label], sha) for i, label, code, error in want), key=repr)
