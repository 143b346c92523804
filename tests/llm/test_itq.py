import numpy as np
import pytest

from rasterlake.llm import itq


def brute(rows, threshold=0.95):
    rows = list(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows))
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].append(b)
                    links[b].append(a)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out.append((rows[k][0], len(links[k]), min(rows[s][0] for s in seen if rows[s][0] is not None)))
    return sorted(out)


@pytest.mark.parametrize("exact", [False, True])
def test_against_brute_force_and_edges(spark, monkeypatch, exact):
    monkeypatch.setattr(itq, "BLOCK", 4)  # many blocks
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((12, 16))
    v = np.concatenate([c + 0.03 * rng.standard_normal((15, 16)) for c in centers]).astype(np.float32)
    rows = [(i + 100, x.tolist()) for i, x in enumerate(v)]
    rows += [(i, rows[0][1]) for i in range(20)]  # copies
    rows += [(30, [2 * x for x in rows[0][1]]), (31, None), (32, [0.0] * 16), (33, [1.0] * 15 + [None]), (34, [float("nan")] * 16), (35, [float("inf")] + [1.0] * 15), (36, []), (37, rows[0][1][:8]), (38, rows[0][1][:8]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, g int, _V int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.embedding_groups(df, exact=exact).collect())
    assert got == brute(rows)
    assert itq.embedding_groups(df.limit(0), exact=exact).count() == 0
    nameless = itq.embedding_groups(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [2.0, -1.0])], "vec_id long, embedding array<double>"), exact=exact)
    assert sorted(map(tuple, nameless.collect()), key=repr) == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False)], key=repr)


def at_threshold(rng, n, dims, mean, cosine=0.951):
    """n vectors whose mean cosine is about `mean`, and a partner of each at `cosine`."""
    a = rng.standard_normal((n, dims))
    a = np.sqrt(1 - mean) * a / np.linalg.norm(a, axis=1, keepdims=True)
    a[:, 0] += np.sqrt(mean)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dims))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [64, 384, 768])
@pytest.mark.parametrize("mean", [0.0, 0.3, 0.5, 0.7])
def test_recall_of_the_tables(dims, mean):
    a, b = at_threshold(np.random.default_rng(3), 2000, dims, mean)
    finder = itq.learn(np.concatenate([a[:1000], b[:1000]]), 0.95, 50_000)
    x, y = finder.labels(a[1000:]), finder.labels(b[1000:])
    kx, ky = finder.keys(x), finder.keys(y)
    met = np.array([any(finder.compared(int(k), x[i : i + 1], y[i : i + 1])[0, 0] for k in np.intersect1d(kx[i], ky[i])) for i in range(len(x))])
    assert met.mean() >= 0.94
    other = (kx == np.roll(ky, 1, axis=0)).any(axis=1).mean()  # unlike vectors that meet
    assert other < (0.05 if mean < 0.6 else 0.2)


@pytest.mark.parametrize("mean", [0.0, 0.6])
def test_query_on_vectors_with_links(spark, tmp_path, mean):
    rng = np.random.default_rng(5)
    x = np.concatenate([*at_threshold(rng, 500, 32, mean, 0.953), *at_threshold(rng, 300, 32, mean, 0.98)])
    x = np.concatenate([x, x[:50], x[7] + 0.01 * rng.standard_normal((80, 32))])
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want = brute(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.op8_itq_multi_index(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[3] == (g[0] == g[2]) for g in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) > 8000
    right = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.embedding_groups(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), exact=True).collect())
    assert right == want


def test_query_on_the_table(spark, sf_dir):
    got = {r.vec_id: r for r in itq.op8_itq_multi_index(spark, sf_dir).collect()}
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.array(list(e.embedding), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(got[i].n_links <= n for i, n in zip(e.vec_id, links, strict=True)) and len(got) == len(e)
    assert sum(r.n_links for r in got.values()) >= 0.9 * links.sum()
