import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.llm import graph, simhash


def plain(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[ \t\n\x0b\x0c\r]+", w) if x]
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="ab É\t\x0b\x1c\xa0Z", max_size=40))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


@pytest.mark.parametrize("max_bits", [2, 3, 6])
def test_no_link_is_lost(max_bits):
    rnd = random.Random(max_bits)
    for _ in range(3000):
        x = 0
        for b in rnd.sample(range(64), rnd.randint(0, max_bits + 2)):
            x |= 1 << b
        near = bin(x).count("1") <= max_bits
        a = np.array([x], dtype=np.uint64)
        chains = [bool(simhash.chained(a, k, max_bits)[0]) for k in range(max_bits + 1)]
        if near:
            assert any(chains)
        found = any(len(simhash.links_of(k, a, np.zeros(1, dtype=np.uint64), max_bits)[0]) for k in range(max_bits + 1))
        assert found == near


def closure(ids, prints, max_bits):
    links = [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= max_bits]
    a, b = (np.array([x[k] for x in links], dtype=int) for k in (0, 1))
    root = graph.forest(len(ids), a, b)
    smallest = {}
    for r, i in zip(root, ids, strict=True):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return [smallest.get(r) for r in root]


@pytest.mark.parametrize("max_bits", [2, 6])
def test_groups_against_brute_force(spark, monkeypatch, max_bits):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # many blocks
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("the a of in and to is was on by".split()) for _ in range(120)) for _ in range(6)]
    texts = []
    for i in range(150):
        w = base[i % 6].split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(30)}"
        texts.append(" ".join(w))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "one two"), (None, "one two")]
    out = simhash.simhash_groups(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string"), max_bits).collect()
    want = closure([r[0] for r in rows], [plain(r[1]) for r in rows], max_bits)
    assert sorted(((r.doc_id, r.component_id, r.fp % (1 << 64)) for r in out), key=repr) == sorted(((i, c, plain(t)) for (i, t), c in zip(rows, want, strict=True)), key=repr)
    assert len(set(want)) < 150


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_pigeonring(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [plain(texts[i]) for i in ids]
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, closure(ids, prints, 2), strict=True)}
    assert len({c for _, c in got.values()}) < len(ids)


def test_long_texts_hot_groups_and_clashing_names(spark, monkeypatch):
    """Of all rows, most are copies of one text, and the join of hot groups takes each way."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(i, long, "x", 1, 2) for i in range(40)] + [(100, long + " w", "x", 1, 2)] + [(200 + i, f"text {i} of its own " * (i + 1), "x", 1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Text string, fp int, component_id int")
    want = closure([r[0] for r in rows], [simhash.fingerprint(r[1]) % (1 << 64) for r in rows], 2)
    for hot in (10_000, 5, 1):
        monkeypatch.setattr("rasterlake.llm.common.HOT", hot)
        got = {r.doc_id: r.component_id for r in simhash.simhash_groups(df).collect()}
        assert got == {r[0]: c for r, c in zip(rows, want, strict=True)}
        kept = simhash.one_of_each_group(df)
        assert kept.columns == df.columns and {0} <= {r.doc_id for r in kept.collect()} and kept.count() <= 7


def test_one_of_each_group(spark):
    t = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(5, t, "a"), (3, t, "b"), (3, t, "b"), (9, "quite another text with some words", "c"), (None, t, "d")], "doc_id long, text string, note string")
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.note) for r in out.collect()) == [(0, "d"), (3, "b"), (9, "c")]
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_clashing_ids_stand_for_their_own_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (5, a), (1, b), (6, b), (0, c), (1, c)]
    out = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted([(1, a), (1, b), (0, c)])


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_key_plan():
    assert simhash.key_plan(0) == simhash.key_plan(200_000) == (29, 13)
    for docs in (10**6, 10**8, 10**10):
        n, bits = simhash.key_plan(docs)
        assert docs / 2**bits <= simhash.BY_CHANCE and (1 - 0.85**bits) ** n <= 1 - simhash.FOUND + 1e-9
        assert n * docs / 2**bits <= 60 * docs**0.24
    h = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.array_equal(simhash.wide_print(h, 30)[:512], simhash.wide_print(h))


@pytest.mark.parametrize("by_chance", [32, 1e-3])
def test_groups_are_those_of_jaccard(spark, monkeypatch, by_chance):
    monkeypatch.setattr(simhash, "BY_CHANCE", by_chance)  # the second one: as many keys as for millions of documents
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 16 << 20 if by_chance == 32 else 4_000)
    rnd, texts, likeness = random.Random(8), [], []
    for k in range(160):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(150, 400))]
        v = list(w)
        for at in range(0, len(w) - 5, len(w) // (3 + k % 5)):
            v[at + 4] = "changed"
        texts += [" ".join(w), " ".join(v)]
        likeness.append(jaccard(*texts[-2:]))
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept >= set(range(0, len(texts), 2))
    near = [2 * k + 1 not in kept for k, x in enumerate(likeness) if x >= 0.8]
    assert len(near) > 100 and np.mean(near) >= 0.95
    under = [2 * k + 1 in kept for k, x in enumerate(likeness) if x < 0.8]
    assert len(under) > 10 and all(under)
    assert sum(0.8 <= x < 0.88 for x in likeness) > 20


def test_blocks_by_number_and_weight(spark):
    rows = [(k, i, 10 if i else 1000) for k in range(3) for i in range(40 * k + 2)]
    df = spark.createDataFrame(rows, "k int, item int, w long")
    plain = graph.bucket_blocks(df, ["k"], "item", 50).collect()
    assert {k: max(r.p for r in plain if r.k == k) + 1 for k in range(3)} == {0: 1, 1: 1, 2: 2}
    heavy = graph.bucket_blocks(df, ["k"], "item", 50, "w", 300).collect()
    assert all(2 <= max(r.p for r in heavy if r.k == k) + 1 <= 7 for k in (1, 2))
    for out in (plain, heavy):
        met = {}
        for r in out:
            for a in r.left:
                for b in r.left if r.right is None else r.right:
                    met[r.k, min(a, b), max(a, b)] = met.get((r.k, min(a, b), max(a, b)), 0) + (a != b or r.right is not None)
        pairs = {key: n for key, n in met.items() if key[1] != key[2]}
        assert set(pairs) == {(k, a, b) for k in range(3) for b in range(40 * k + 2) for a in range(b)} and set(pairs.values()) <= {1, 2}


@pytest.mark.parametrize("hot", [10_000, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr("rasterlake.llm.common.HOT", hot)
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (101, 101), (200, 300), (300, 250), (None, 4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [12, 16, 26, 48, 64])
def test_no_link_is_lost_on_short_rings(bits):
    rnd, ring, got = random.Random(bits), (1 << bits) - 1, set()
    for _ in range(1500):
        x = sum(1 << b for b in rnd.sample(range(bits), rnd.randint(0, 5)))
        above = rnd.getrandbits(64) & ~ring & (1 << 64) - 1  # bits above the ring count for nothing
        a, b = np.array([x | above], dtype=np.uint64), np.zeros(1, dtype=np.uint64)
        found = [len(simhash.links_of(k, a, b, 2, bits)[0]) == 1 for k in range(3)]
        assert any(found) == (x.bit_count() <= 2)
        got.add(any(found))
    assert got == {True, False}


def test_ring_plan():
    assert simhash.ring_plan(0) == simhash.ring_plan(200_000) == (6, 16)
    for docs in (10**6, 10**7, 10**9):
        rings, bits = simhash.ring_plan(docs)
        within = sum(simhash.math.comb(bits, k) * 0.15**k * 0.85 ** (bits - k) for k in range(3))
        assert 1 - (1 - within) ** rings >= simhash.ON_RINGS and docs / 2 ** (bits // 2) <= simhash.BY_CHANCE << simhash.SHORTER


def test_candidates_are_all_those_of_the_rings(spark, monkeypatch):
    """By brute force: within 2 bits on some ring, and within 28 of 128."""
    monkeypatch.setattr(simhash, "BLOCK", 4)  # many blocks
    rnd, width, rows = random.Random(3), 16, []
    flip = lambda x, low, high, n: x ^ sum(1 << b for b in rnd.sample(range(low, high), n))
    for _ in range(40):
        c, above, rings = rnd.getrandbits(64), rnd.getrandbits(48) << width, [rnd.getrandbits(width) for _ in range(3)]
        for _ in range(5):
            high = flip(above, width, 64, rnd.randint(0, 9))
            rows.append((len(rows) - 90, flip(c, 0, 64, rnd.randint(0, 12)), [high | flip(r, 0, width, rnd.randint(0, 4)) for r in rings]))
    off = lambda a, b: [(a[1] ^ b[1]).bit_count() + (x ^ y).bit_count() for x, y in zip(a[2], b[2], strict=True)]
    on = lambda a, b: [((x ^ y) & (1 << width) - 1).bit_count() for x, y in zip(a[2], b[2], strict=True)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if any(x <= 28 and y <= 2 for x, y in zip(off(rows[i], rows[j]), on(rows[i], rows[j]), strict=True))]
    root = graph.forest(len(rows), *(np.array([p[k] for p in pairs]) for k in (0, 1)))
    linked = {k for p in pairs for k in p}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(n, signed(c), [signed(r) for r in rings]) for n, c, rings in rows], "node long, c long, rings array<long>")
    got = {r.node: r.component for r in simhash.likely_groups(df, width).collect()}
    assert got == {rows[k][0]: rows[root[k]][0] for k in linked}
    assert 60 < len(linked) < len(rows)
    assert any(min(on(rows[i], rows[j])) == 2 for i, j in pairs)
