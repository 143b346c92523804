import html.parser
import re

import pytest

from rasterlake.llm.html_text import extract_text, merged, op3_layout_html, visible_text, without

CASES = [
    (None, None),
    ("", ""),
    ("a < b & c", "a < b & c"),
    ("<p>One<p>Two <b>bold</b> x<br>y", "One\n\nTwo bold x\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li>y<br>z</ol>", "3. x\n4. y\n   z"),
    ("<table><tr><th>Name<th>N<tr><td>longer name<td>1</table>", "Name        | N\nlonger name | 1"),
    ("<table><caption>C</caption><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "C\nwide |   | x\na    | b | c"),
    ("<table><tr><td>二<td>x<tr><td>ab<td>y</table>", "二 | x\nab | y"),
    ('a<div style="color:red; display : none">no</div><span hidden>no</span><i style="visibility:hidden">no</i>b', "ab"),
    ("<head><title>t</title><style>p{}</style></head><body><script>var a='</p>';</script>x<!-- no --></body>", "x"),
    ("<pre>a  b\n  c\n\nd</pre>e", "a  b\n  c\n\nd\n\ne"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("&amp;&eacute;&#x41;&nbsp;z", "&éA\xa0z"),
    ("x</div></b></p>y", "xy"),
    ('<a href="a>b">link</a> <img alt="pic"> z', "link pic z"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("a<svg/>b<svg><path/>c</svg>d", "abd"),
    ("<p>a   b\n c</p>", "a b c"),
    ("one<hr>two", "one\n\n---\n\ntwo"),
    ("<p", ""),
]


IN_TABLES = [
    ("<table><td>A<td>B</table>", "A | B"),
    ("<table><tbody><td>A", "A"),
    ("<table><form><tr><td>x<td>y</form></table>z", "x | y\n\nz"),
    ("<table>text<tr><td>x</table>", "text\n\nx"),
    ("<table><tr><div>text</div><td>x</table>", "text\n\nx"),
    ("<table><tr><td>a</td>loose<td>b<tr><td>c</table>", "loose\n\na | b\nc"),
    ("<table><tr><td>a</tr><td>b</table>", "a\nb"),
    ("<table><div>d<td>a<td>b</table>", "d\n\na | b"),
    ("<table><tr><td>a<table><td>in</table>b</table>", "a\n\nin\n\nb"),
    ("<table><tr><td>a<tr><table><tr><td>b</table>", "a\n\nb"),
    ("<table><colgroup><col>loose<tr><td>a</table>", "loose\n\na"),
    ("<table><tr><td>a<caption>C</table>", "C\na"),
    ("<table><b>x</b>y<tr><td>z</table>w", "xy\n\nz\n\nw"),
    ("<tr><td>a</td><td>b</td></tr>", "ab"),
    ("a<dialog open>b</dialog><dialog>c</dialog>", "a\nb"),
]


SPANS = [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>", "a | b | c\nd |   | e\nf |   | g\nh | i | j"),
    ("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C<tr><td>x<td>y<td>z</table>", "A |   | B\n  |   | C\nx | y | z"),
    ("<table><tbody><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>", "A | B\nC | D"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A | B\n  | C\n  | D"),
    ("<table><tr><td rowspan=x>A<td rowspan=-2>B<tr><td>C</table>", "A | B\nC"),
    ("<table><tr style='display:none'><td>no<tr><td>a<td style='visibility:hidden'>no<td>b</table>", "a |  | b"),
]
SEEN = [
    ("<details><summary>S</summary>no<p>no</details>x", "S\nx"),
    ("<details open><summary>S</summary>yes</details>x", "S\nyes\nx"),
    ("<details>no</details>x", "x"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<div style='display:none'>no<b style='display:block;visibility:visible'>no</b></div>x", "x"),
    ("<style>.a{display:none} #b{visibility:hidden} i.c{display:none}</style><p class='x a'>no<p id=b>no<p><i class=c>no</i><b class=c>yes</b>", "yes"),
    ("<style>p{display:none} .on{display:block}</style><p>no<p class=on>yes", "yes"),
    ("<style>.a{display:none !important}</style><p class=a style='display:block'>no</p><p style='display:none' class=b>no</p>x", "x"),
    ("<style>@media print{.a{display:none}} @media screen{.b{display:none}} /* .c{display:none} */</style><i class=a>1</i><i class=b>2</i><i class=c>3</i>", "13"),
    ("<style>div p{display:none} a:hover{display:none}</style><div><p>yes <a>too</a></div>", "yes too"),
    ("<style>.a{display:block}</style><p hidden class=a>yes<p hidden>no", "yes"),
    ("a<span style='display:block'>b</span>c<div style='display:inline'>d</div>e", "a\nb\ncde"),
    ("<i aria-hidden=true>icon</i> x", "icon x"),
    ("<ul><li><p>a</p></li><li><p>b</p><p>c</p></li></ul>", "- a\n- b\n\n  c"),
    ("<ol start=9><li>a<li>b<ul><li>c<br>d</ul></ol>", "9. a\n10. b\n    - c\n      d"),
    ("<blockquote><ul><li>a</ul></blockquote>b", "  - a\n\nb"),
    ("<ul><li><ul><li>x</ul></ul>", "- - x"),
]


@pytest.mark.parametrize(("page", "text"), SPANS + SEEN)
def test_spans_and_visibility(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(("page", "text"), IN_TABLES)
def test_nothing_in_a_table_is_lost(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert visible_text(page) == text


def test_deep_and_broken_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<div>" * 5000 + "<div hidden>secret</div>x") == "x"
    assert visible_text("<p><b>" * 20_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 2000 + "x") == "x"
    assert visible_text("<ul><li>" * 3000 + "x").endswith("- x")
    deep = visible_text("".join(f"<ul><li>w{i}" for i in range(2000))).split("\n")
    assert [x.split()[-1] for x in deep] == [f"w{i}" for i in range(2000)] and max(map(len, deep)) < 100
    assert len(visible_text("<p>word " * 50_000)) > 50_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (2, None, "old")], "page_id long, html string, Text string")
    assert extract_text(df).columns == ["page_id", "html", "text"]
    assert sorted((r.page_id, r.text) for r in extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, None)]
    rows = extract_text(spark.createDataFrame([("<p>a", "b", "c", 1)], "html string, HTML string, out string, row int"))
    assert rows.columns == ["html", "HTML", "out", "row", "text"] and tuple(rows.first()) == ("<p>a", "b", "c", 1, "a")
    assert extract_text(df.limit(0)).count() == 0


class Words(html.parser.HTMLParser):
    """The words of a page outside of what never shows, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_query_keeps_every_visible_word(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op3_layout_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        w = Words()
        w.feed(pages[r.page_id])
        assert re.sub(r"(?m)^ *- ", "", r.text).split() == w.words


def test_many_spans():
    import time
    import tracemalloc

    spanned = "<table><tr><td colspan=1000 rowspan=0>top<td rowspan=0>x" + "<tr><td>y" * 65_534 + "</table>"
    tracemalloc.start()
    began = time.perf_counter()
    text = visible_text(spanned)
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 600e6  # both are far less without tracing
    tracemalloc.stop()
    lines = text.split("\n")
    assert len(lines) == 65_535 and lines[0] == "top | x" and set(lines[1:]) == {"    |   | y"}
    stairs = "".join(f"<tr><td rowspan=0>c{k}" for k in range(3000))
    assert visible_text(f"<table>{stairs}</table>").split("\n") == [f"c{k}" for k in range(3000)]


def test_columns_without_text():
    page = "<table><tr><td>a<td><td>b<tr><td colspan=3>c<td>d<tr><td><td rowspan=2><td>e<td>f<tr><td>g<td>h</table>"
    assert visible_text(page) == "a |  | b\nc |  |   | d\n  |  | e | f\ng |  | h"
    assert visible_text("<table><tr><td colspan=3>a<td>b<tr><td colspan=3>c<td>d</table>") == "a | b\nc | d"


def test_spans_of_spans():
    spans = merged(without([(0, 5, 3.0), (7, 9, 4.0)], 2, 8) + [(2, 8, 9.0)])
    assert spans == [(0, 2, 3.0), (2, 8, 9.0), (8, 9, 4.0)]
    assert merged([(4, 5, 2.0), (0, 4, 2.0), (6, 7, 2.0)]) == [(0, 5, 2.0), (6, 7, 2.0)]
