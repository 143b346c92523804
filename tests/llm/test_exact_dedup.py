import hashlib
from collections import defaultdict

import pytest
from conftest import same_rows

from rasterlake.llm import common, exact_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        first = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m is first or m == first, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


LONG = "the same beginning of sixty-four characters and more than that, " * 3
ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\x0b\x0c\r\n\t b"), (9, "a\xa0b"), (4, None), (5, ""), (6, " \n"), (None, "ab   "), (None, "only null"), (None, "only null"),
    (7, LONG + "x"), (8, LONG + "y"), (10, LONG + " x"), (11, LONG + "x "), (12, "é à"), (13, "éà"), (14, "éà"), (15, "x" * 300_000), (16, "x " * 300_000), (16, "x " * 300_000), (16, "other, same id"),
    *[(20 + i, "one text of many rows") for i in range(30)], (20, "one text of many rows"), *[(100 + i, f"text number {i}") for i in range(20)],
]


@pytest.mark.parametrize("hot", [common.HOT, 5])
def test_against_brute_force_and_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    df = spark.createDataFrame([(i, t, "c", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, _full string, row int").repartition(5)
    got = exact_dedup.exact_groups(df, digest_col="sha")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "sha"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)
    narrow = exact_dedup.exact_groups(df)
    assert sorted(map(tuple, narrow.collect()), key=repr) == sorted((r[:4] for r in brute(ROWS)), key=repr)
    stay = exact_dedup.without_copies(df)
    assert stay.columns == df.columns
    squeeze = lambda t: "".join(c for c in t or "" if c not in SPACE)
    want = sorted(((r[0], r[4]) for r in brute(ROWS) if r[3]), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256(squeeze(r.text).encode()).hexdigest()) for r in stay.collect()), key=repr) == want
    assert exact_dedup.exact_groups(df.limit(0)).count() == exact_dedup.without_copies(df.limit(0)).count() == 0


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a ", "c")], "doc_id long, text string, other string").toDF("doc_id", "text", "DOC_ID")
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect())) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert [tuple(r) for r in exact_dedup.without_copies(df).collect()] == [(2, "a ", "c")]


@pytest.mark.parametrize("bits", [common.BITMAP, common.MOST_BITS])
def test_sieves_lose_no_row(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rows = spark.range(20_000).selectExpr("id div 2 as k").union(spark.range(50_000, 90_000).selectExpr("id as k"))
    out = common.marked(rows, "k", *exact_dedup.shared(rows, "k", "keys"))
    assert out.where("k < 10000 and not _may").count() == 0
    through = out.where("k >= 50000 and _may").count()
    assert through < 6_000 if bits > common.BITMAP else through > 0


def test_query(spark, sf_dir, duck):
    out = exact_dedup.op11_progressive_exact_dedup(spark, sf_dir)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same_rows(out, duck, exact_dedup.ORACLE_SQL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
