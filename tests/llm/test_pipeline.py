"""The pipeline's stages against plain Python."""

import os
import re

import numpy as np
import pytest
from test_decontaminate import ITEM
from test_line_dedup import brute as line_brute
from test_packing import check
from test_simhash import jaccard

import corpus_pipeline
from rasterlake.llm import graph
from rasterlake.llm.common import stored

EN = "the river runs by the old house and the children play there with the dog every day until it is dark"
DE = "der fluss fließt am alten haus vorbei und die kinder spielen dort jeden tag mit dem hund bis es dunkel wird"


def groups_of(texts):
    """The group of each text by links of five-word Jaccard similarity 0.8."""
    low = [(t or "").lower() for t in texts]
    links = [(i, j) for i in range(len(low)) for j in range(i) if low[i] == low[j] or (min(len(low[i].split()), len(low[j].split())) > 4 and jaccard(low[i], low[j]) >= 0.8)]
    return graph.forest(len(low), *(np.array([x[k] for x in links], dtype=int) for k in (0, 1))).tolist()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    shared = "This line of text stands in a good many documents of the set"
    docs = [(i, f"{EN} number {i} " + " ".join(f"word{i}x{k}" for k in range(60)) + f"\n{shared}", "en") for i in range(10)]
    docs += [(20 + i, DE + f" nummer {i} " + " ".join(f"wort{i}y{k}" for k in range(60)), "de") for i in range(5)]
    docs += [(30, docs[0][1].split("\n")[0], "en"), (31, docs[0][1].split("\n")[0], None)]  # copies of document 0
    docs += [(40, "1234 !!", "en"), (41, None, "en"), (42, f"{EN} as they say. {ITEM} And so on.", "en"), (None, f"{EN} but no id", "en")]
    df = spark.createDataFrame([(i, t, x, f"src{n % 3}", len(t or "")) for n, (i, t, x) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), "stage"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    assert all(df.schema.names == docs.schema.names for df in out[:-1])
    rows = [[tuple(r) for r in df.collect()] for df in out[:-1]]
    ids = lambda rs: sorted((r[0] for r in rs), key=repr)
    assert ids(rows[1]) == ids(r for r in rows[0] if r[1] and re.search(r"[^\W\d_]", r[1]))
    want = {i: t for i, t, _, _ in line_brute([r[:2] for r in rows[1]])}
    assert {r[0]: r[1] for r in rows[2]} == want and all(r[4] == len(r[1]) for r in rows[2])
    group = groups_of([r[1] for r in rows[2]])
    first = {}
    for r, g in zip(rows[2], group, strict=True):
        if r[0] is not None:
            first[g] = min(r[0], first.get(g, r[0]))
    assert ids(rows[3]) == sorted((r[0] for r, g in zip(rows[2], group, strict=True) if r[0] is None or r[0] == first[g]), key=repr)
    assert len(set(group)) < len(group)
    assert ids(rows[4]) == ids(r for r in rows[3] if ITEM not in r[1]) and len(rows[4]) < len(rows[3])
    pieces = out[-1].collect()
    check([r[:2] for r in rows[4]], pieces, 1024)
    ran = corpus_pipeline.run(spark, small).collect()
    key = lambda p: (p.doc_id is None, p.doc_id, p.start, p.length, p.ids_crc32, p.sequence_id, p.offset)
    assert sorted(map(key, ran), key=repr) == sorted(map(key, pieces), key=repr)


def test_run_clears_its_scratch(spark, small):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, small).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert rows > 0 and left == {"decontamination", "tokens", "places"}


def test_clashing_names_ties_repeats_and_long_texts(spark, small):
    long = " ".join(f"{EN} {i}" for i in range(4000))
    rows = [(7, long, "en", 1), (7, long, "en", 1), (3, long, "en", 2), (9, "the river runs by the house", "en", 3), (9, "the dog and the children play all day", "en", 4), (None, "the old house is dark", None, 5), (11, None, "en", 6), (12, "", "en", 7), (13, DE, "de", 8), (14, DE, "de", 9)]
    df = spark.createDataFrame([(*r, "a", 1.0, 2, 3, 4, "z") for r in rows], "doc_id long, text string, lang string, mark int, row string, score double, h int, node int, n_dropped int, TEXT string")
    docs, kept = df, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small).toDF(*[f"c{i}" for i in range(10)]), "stage").toDF(*df.columns)
        assert docs.columns == df.columns
        kept.append([r["mark"] for r in docs.collect()])
        assert all(tuple(r)[4:] == ("a", 1.0, 2, 3, 4, "z") for r in docs.collect())
    assert [sorted(k) for k in kept] == [[1, 1, 2, 3, 4, 5, 8, 9], [1, 1, 2, 3, 4, 5, 8, 9], [2, 3, 4, 5, 8], [2, 3, 4, 5, 8]]
    pieces = corpus_pipeline.pack(spark, docs, small).collect()
    check([(r[0], r[1]) for r in docs.collect()], pieces, 1024)


def test_empty_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "stage")
        assert docs.count() == 0
