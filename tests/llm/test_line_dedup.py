import hashlib
from collections import defaultdict

from conftest import same_rows

from rasterlake.llm import line_dedup

SHARED = "This very line is in many documents"


def brute(rows, min_chars=20, min_docs=3):
    keys = defaultdict(set)
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                keys[norm(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(norm(x)) < min_chars or len(keys[norm(x)]) < min_docs or i == max(keys[norm(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force_and_edges(spark):
    rows = [
        (1, f"{SHARED}\nown one\n\n{SHARED.upper()} "),
        (2, f"\t{SHARED}"),
        (3, f"own three is a line of its own\n{SHARED}\n{SHARED}"),
        (3, f"own three is a line of its own\n{SHARED}\n{SHARED}"),  # a repeated row
        (3, f"{SHARED}\nanother text, same id"),
        (None, f"{SHARED}\nno id"),
        (4, None),
        (5, ""),
        (6, "É" * 20 + "\n" + "short"),
        (7, "É" * 20 + "\n" + "short"),
        (8, "É" * 20 + "\n" + "short\n\n"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, `_row` string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_row", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert got == brute(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_many_lines_in_one_document(spark):
    text = "\n".join([SHARED] * 3000 + [f"line number {i} of the long document" for i in range(3000)])
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, SHARED), (3, SHARED)], "doc_id long, text string")).collect()}
    assert (out[1].n_lines, out[1].n_dropped, out[2].text, out[3].text) == (6000, 3000, "", SHARED)


def test_query(spark, sf_dir, duck):
    out = line_dedup.op7_line_dedup(spark, sf_dir)
    same_rows(out, duck, line_dedup.ORACLE_SQL)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
