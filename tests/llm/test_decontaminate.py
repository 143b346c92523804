import random
import re
from collections import Counter, defaultdict

import numpy as np

from rasterlake.llm import decontaminate as dc

ITEM = "Tom saw that Ann has 3 red apples and gives Bob 2 red apples every single day. How many km does Ann walk with 3 apples in 7 days?"


def test_templates():
    t = dc.templates([ITEM, "Ann 12kg 5 KM x2 A. Ann\nAnn"])
    words = [(i, s) for i, s in zip(t.text.tolist(), t.slot.tolist(), strict=True)]
    assert [s for i, s in words if i == 1] == [False, True, True, True, False, False, False, False]
    slots = [ITEM[a:b] for a, b, s, i in zip(t.start, t.end, t.slot, t.text, strict=True) if s and i == 0]
    assert slots == ["Ann", "3", "Bob", "2", "Ann", "3", "7", "days?"]
    same = dc.templates(["| the ** cat's, é", "THE cats É"])
    assert same.h[:3].tolist() == same.h[3:].tolist()


def test_reparameterised_questions():
    new = ITEM.replace("Ann", "Eva").replace("Bob", "Max").replace("3", "8").replace("2", "5").replace("7", "9")
    share, run, slots = dc.compare(f"Some words before it. {new} And after.", ITEM)
    assert share >= 0.9 and slots["ann"] == "eva" and slots["3"] == "8"
    torn = new.replace("8 apples", "6 apples").replace("Eva walk", "Zed walk")  # other values where the item repeats its own
    assert dc.compare(torn, ITEM)[0] < share - 0.1
    assert dc.compare("1 2 3 4 5 6 7 8 9", "9 8 7 6 5 4 3 2 1")[0] == 0.0
    assert dc.compare(None, ITEM)[0] == dc.compare(ITEM, None)[0] == 0.0


def test_rows_and_edges(spark):
    rows = [(1, f"before {ITEM} after"), (2, "clean text without any of it at all"), (3, None), (4, ""), (5, ITEM), (5, ITEM), (None, ITEM), (6, " ".join(ITEM.split()[:9])), (7, "word " * 200_000 + ITEM)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, run int")
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "too short", "x"), (10, ITEM, "y")], "item_id long, text string, doc_id string")
    leaks = dc.find_leaks(docs, bench)
    assert sorted(((r.doc_id, r.item_id) for r in leaks.collect()), key=repr) == sorted([(1, 10), (5, 10), (None, 10), (7, 10)], key=repr)
    left = dc.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6]
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of it in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert [r.doc_id for r in dc.find_leaks(docs, bench).collect()] == [1]


def plain_windows(text):
    """(window, slots' values with their places in it) of the words of a text, by the rules in words."""
    words, new, out = [], True, []
    for m in re.finditer(r"\S+|\n", text or ""):
        w = m[0]
        if w == "\n":
            new = True
            continue
        core = "".join(c for c in w if c.isalnum())
        if not core:
            new |= w[-1] in ".!?:"
            continue
        digits = sum(c.isdecimal() for c in core)
        kind = core.lower()
        if core[0].isdecimal() and len(core) - digits <= 3:
            kind = "<num>"
        elif words and words[-1][0] == "<num>" and kind in dc.UNITS:
            kind = "<unit>"
        elif core[0].isupper() and sum(c.isupper() for c in core) == 1 and len(core) > 1 and not digits and not new:
            kind = "<name>"
        words.append((kind, w.lower().strip(".,;:!?\"'()[]{}")))
        new = w[-1] in ".!?:"
    for i in range(len(words) - 4):
        part = words[i : i + 5]
        if sum(k[0] == "<" for k, _ in part) <= 3:
            out.append((i, tuple(k for k, _ in part), [(j, v) for j, (k, v) in enumerate(part) if k[0] == "<"]))
    return out


def plain_leak(text, item, share=0.8, run=13):
    """Whether the text leaks the item, over all pairs of their windows."""
    ours, theirs = plain_windows(text), plain_windows(item)
    pairs = [(i, t, k, a, b) for i, k, a in theirs for t, k2, b in ours if k == k2]
    diagonal = Counter(t - i for i, t, *_ in pairs)
    votes = defaultdict(Counter)
    for i, t, _, a, b in pairs:
        for (_, x), (_, y) in zip(a, b, strict=True):
            votes[x][y] += diagonal[t - i]
    bound = {x: min(c, key=lambda y: (-c[y], y)) for x, c in votes.items()}
    good = {(i, k) for i, _, k, a, b in pairs if all(bound[x] == y for (_, x), (_, y) in zip(a, b, strict=True))}
    on, best, now = {i for i, _ in good}, 0, 0
    for i, *_ in theirs:
        now = (now + 1 if i - 1 in on else 1) if i in on else 0
        best = max(best, now)
    return bool(theirs) and (len({k for _, k in good}) / len({k for _, k, _ in theirs}) >= share or best + 4 >= run)


def test_against_brute_force_over_templates(spark):
    rnd = random.Random(4)
    pool = "the a of train leaves carries boxes from town with and then how many more does it need each day".split()
    names, units = ["Ann", "Bob", "Eva", "Max", "Lea"], ["km", "kg", "days", "hours"]

    def question():
        out = []
        for _ in range(rnd.randint(6, 40)):
            out.append(rnd.choice([rnd.choice(pool)] * 7 + [str(rnd.randint(2, 9)), f"{rnd.randint(2, 9)} {rnd.choice(units)}", rnd.choice(names)]))
        return "Since " + " ".join(out) + "."

    def other(text, torn):
        swap = {x: rnd.choice(names) for x in names} | {str(d): str(rnd.randint(10, 99)) for d in range(2, 10)}
        return " ".join(rnd.choice([swap[w], "77"]) if w in swap and rnd.random() < torn else swap.get(w, w) for w in text.split())

    items = [question() for _ in range(60)]
    items += [other(t, 0) for t in items[:15]]  # the same templates with other values
    docs = [f"Before it. {other(rnd.choice(items), rnd.choice([0, 0, 0.3]))} And after." for _ in range(60)]
    docs += [" ".join(rnd.choice(items).split()[: rnd.randint(5, 30)]) for _ in range(40)] + [question() for _ in range(20)]
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if plain_leak(d, t)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = dc.item_classes(bench).collect()
    leaks = dc.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()
    members = defaultdict(set)
    for r in rows:
        members[r["class"]].add(r.item_id)
    named = {min(m): m for m in members.values()}
    assert {(r.doc_id, k) for r in leaks for k in named[r.item_id]} == want and all(r.n_items == len(named[r.item_id]) for r in leaks)
    assert len(want) > 60 and len(leaks) < len(want)


def test_a_window_that_all_items_share(spark, monkeypatch):
    """It makes no pairs, whether windows are broadcast or shuffled."""
    head = "Read the following text and answer the question"
    items = [f"{head} " + " ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)]
    docs = [f"{head} " + " ".join(f"z{i}y{k}" for k in range(30)) for i in range(50)] + [items[3], items[7] + " and more"]
    for most in (10**6, 0):
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", most)
        near = []
        keep = dc.stored
        monkeypatch.setattr(dc, "stored", lambda df, name, keep=keep, near=near: near.append((name, out := keep(df, name))) or out)
        leaks = dc.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
        monkeypatch.setattr(dc, "stored", keep)
        assert sorted((r.doc_id, r.item_id) for r in leaks) == [(50, 3), (51, 7)]
        assert dict(near)["near"].count() == 2


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, 2, "x"), (2, "clean", 1, 2, "y")], "doc_id long, text string, _h int, leak int, TEXT string")
    bench = spark.createDataFrame([(10, ITEM, 5, 6)], "item_id long, text string, Item_ID int, class int")
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()] == [(1, 10)]
    left = dc.without_leaks(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 1, 2, "y")]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: [re.sub(r"[\W_]", "", w.lower()) for w in t.split() if re.search(r"[^\W_]", w)]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [norm(t)] for i in range(len(w) - 4)}
    bench = [(r.item_id, grams(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    share = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        g = grams(r.text)
        for i, b in bench:
            if b:
                share[r.doc_id, i] = len(g & b) / len(b)
    got = {(r.doc_id, r.item_id) for r in dc.op6_template_decontamination(spark, sf).collect()}
    assert {k for k, s in share.items() if s >= 0.9} <= got <= {k for k, s in share.items() if s >= 0.5}
    assert np.mean([k in got for k, s in share.items() if s > 0.99]) == 1
