"""HTML extraction that follows the page's layout.

A page is tokenised and fed to a small tree builder with the usual implied end tags; what is not visible is left out;
blocks, lists, preformatted text and tables are rendered as text with their spacing, cells aligned in columns. Pages are
independent of each other, so this is one pass over their rows.
"""

from __future__ import annotations

import bisect
import html
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.common import Carried, bounded_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that never show.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video svg math datalist select noembed noframes title meta link dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tr ul caption".split())
#: Blocks with an empty line around them.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: A start tag closes an open element of the first set, if none of the second set is met before.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
}
#: Where only parts of a table may stand, and what stays there; all other content is moved before the table.
GROUPS = frozenset("thead tbody tfoot".split())
IN_TABLE = GROUPS | {"table", "tr"}
PARTS = IN_TABLE | frozenset("caption colgroup col td th script style template".split())
SCOPE = frozenset("table td th caption html body button".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
#: The standard's limits of how many columns and rows a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: How many times its text, and how many characters, a table may take before it is laid out without columns.
LOOSE, LEAST_LOOSE = 64, 1 << 20
#: Columns that lists and quotes are indented by, at most; what is nested deeper stands there too.
MOST_INDENT = 80
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+)*)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
INLINE = frozenset("inline inline-block inline-flex inline-grid contents".split())


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], children: list | None = None):
        self.tag, self.attributes, self.children = tag, attributes, children or []


def attributes_of(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v[1:-1] if v[:1] in "\"'" else v) or "") for k, v in reversed(ATTRIBUTE.findall(text))} if text.strip() else {}


class Open:
    """The open elements, the root first, and where those of each tag are: finding one takes no walk over the others."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        """Closes the innermost elements, until `size` are open."""
        while len(self.nodes) > max(size, 1):
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of the tags, 0 if there is none."""
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)

    @property
    def top(self) -> Node:
        return self.nodes[-1]


def close(stack: Open, tags, bounds) -> None:
    """Closes the innermost open element of `tags`, with all in it, unless one of `bounds` is inside of it."""
    place = stack.last(tags)
    if place and place >= stack.last(bounds):
        stack.cut(place)


def to_table_parts(stack: Open, tag: str) -> None:
    """Makes ready for a start tag in a table: what it cannot stand in is closed, and the row of a cell is opened."""
    if stack.top.tag == "colgroup" and tag not in ("col", "template"):
        stack.cut(len(stack.nodes) - 1)
    if tag not in PARTS or tag in ("script", "style", "template"):
        return
    table = stack.last({"table"})
    if not table:
        return
    if tag == "table":
        if stack.top.tag in IN_TABLE:  # a table right in a table is the next one
            stack.cut(table)
        return
    if stack.last({"td", "th", "caption"}) > table:
        if tag not in ("caption", "colgroup", "col"):
            return  # CLOSES has closed what it may
        stack.cut(table + 1)
    into = {"td": IN_TABLE, "th": IN_TABLE, "tr": GROUPS | {"table"}, "col": {"table", "colgroup"}}.get(tag, {"table"})
    stack.cut(max(stack.last(into), 0) + 1)
    if tag in ("td", "th") and stack.top.tag != "tr":
        row = Node("tr", {})
        stack.top.children.append(row)
        stack.push(row)


def add(stack: Open, child: Node | str) -> None:
    """Puts child into the innermost open element, or before the table in which it may not stand."""
    if stack.top.tag == "colgroup" and isinstance(child, str) and SPACES.sub("", child):
        stack.cut(len(stack.nodes) - 1)
    top = stack.top
    if top.tag not in IN_TABLE or (child.tag in PARTS if isinstance(child, Node) else not SPACES.sub("", child)):
        top.children.append(child)
        return
    at = stack.last({"table"})
    if not at:  # a row or a group outside of any table
        top.children.append(child)
        return
    before = stack.nodes[at - 1].children
    before.insert(next((i for i in range(len(before) - 1, -1, -1) if before[i] is stack.nodes[at]), len(before)), child)


def tree(page: str) -> tuple[Node, list[str]]:
    """(the page as nested elements and strings, its style sheets). Unclosed elements end with their parent, stray end tags
    are ignored."""
    root, sheets = Node("html", {}), []
    stack, at = Open(root), 0
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            add(stack, html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close(stack, {tag}, {"table"} if tag in IN_TABLE - {"table"} else SCOPE - {tag} if tag not in ("table", "body", "html") else ())
            continue
        if tag in ("html", "body"):
            root.attributes = {**attributes_of(m[3]), **root.attributes}
            close(stack, {"head"}, ())
            continue
        if tag in CLOSES:
            tags, bounds = CLOSES[tag]
            while (place := stack.last(tags)) > stack.last(bounds):
                stack.cut(place)
        elif tag in BLOCK:
            close(stack, {"p"}, SCOPE)
        to_table_parts(stack, tag)
        node = Node(tag, attributes_of(m[3]))
        if tag == "form" and stack.top.tag in IN_TABLE:  # an empty element there
            continue
        add(stack, node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.IGNORECASE).search(page, at)
            if tag in ("textarea", "xmp"):
                node.children.append(page[at : end.start()])
            elif tag == "style":
                sheets.append(page[at : end.start()])
            at = end.end()
        elif tag not in VOID and not (tag in ("svg", "math") and m[3].rstrip().endswith("/")):
            stack.push(node)
    if at < len(page):
        add(stack, html.unescape(page[at:]))
    return root, sheets


class Sheet:
    """What style sheets say of display and visibility by element, class and id. Selectors with combinators, attributes or
    pseudo-classes are left out, and of conditional rules all but those of `@media all` and `@media screen`."""

    def __init__(self, sheets: list[str]):
        self.rules = {}
        for order, (selectors, body) in enumerate(rule for css in sheets for rule in self.split(COMMENT.sub(" ", css))):
            said = {k.lower(): (v.lower(), bool(important)) for k, v, important in DECLARATION.findall(body)}
            for one in map(str.strip, selectors.split(",")) if said else ():
                m = SELECTOR.fullmatch(one)
                if not m or not one:
                    continue
                marks = re.findall(r"[#.][\w-]+", m[2])
                tag = (m[1] or "*").lower()
                rank = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), int(tag != "*"), order)
                self.rules.setdefault(marks[-1] if marks else tag, []).append((tag, frozenset(marks), rank, said))

    @staticmethod
    def split(css: str):
        """(selectors, declarations) of the rules that hold."""
        above, start = [], 0
        for m in re.finditer(r"[{}]", css):
            if m[0] == "{":
                above.append(css[start : m.start()].rsplit(";", 1)[-1].strip())
            elif above:
                head = above.pop()
                if not head.startswith("@") and all(re.fullmatch(r"@media\s+(all|screen)", x, re.IGNORECASE) for x in above):
                    yield head, css[start : m.start()]
            start = m.end()

    def look(self, node: Node) -> tuple[str | None, str | None]:
        """(display, visibility) that author's rules give the element; inline ones win, important ones over all."""
        a = node.attributes
        best = {}
        if self.rules:
            marks = {f".{x}" for x in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
            for key in (*marks, node.tag, "*"):
                for tag, needed, rank, said in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and needed <= marks:
                        for k, (value, important) in said.items():
                            best[k] = max(best.get(k, ((False, (-1,)), "")), ((important, rank), value))
        for k, value, important in DECLARATION.findall(a.get("style", "")) if "style" in a else ():
            best[k.lower()] = max(best.get(k.lower(), ((False, (-1,)), "")), ((bool(important), (2**31,)), value.lower()))
        return tuple(best[k][1] if k in best else None for k in ("display", "visibility"))

    def shown(self, node: Node, seen: bool) -> tuple[bool, bool, str | None]:
        """(whether the element is laid out, whether its own text shows, its display); seen is whether its parent's does."""
        a, tag = node.attributes, node.tag
        if (tag in HIDDEN and not (tag == "dialog" and "open" in a)) or (tag == "input" and a.get("type", "").lower() == "hidden"):
            return False, False, None
        if not self.rules and "style" not in a:
            return "hidden" not in a, seen, None
        display, visibility = self.look(node)
        if visibility in ("visible", "hidden", "collapse"):
            seen = visibility == "visible"
        return display != "none" and (display is not None or "hidden" not in a), seen, display


def width(text: str) -> int:
    """Columns that text takes in a fixed-width font."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of text as they are laid out. Blank lines and blanks are put in only before what follows them.

    Lists and quotes are frames [lead, columns before it, blank line due before it, begun]: the lead stands before the
    frame's first line, spaces of the same width before the others."""

    def __init__(self):
        self.done, self.line, self.space, self.blank, self.frames = [], [], False, False, []

    def text(self, text: str) -> None:
        for i, word in enumerate(SPACES.split(text)):
            self.space |= i > 0
            if word:
                self.put((" " if self.space and self.line else "") + word)

    def put(self, text: str) -> None:
        if not self.line:
            new = len(self.frames)
            while new and not self.frames[new - 1][3]:
                new -= 1
            due = self.frames[new][2] if new < len(self.frames) else self.blank
            if due and self.done:
                self.done.append("")
            self.blank = False
            self.line.append(" " * self.indent(new))
            for frame in self.frames[new:]:
                frame[3] = True
                self.line.append(frame[0])
        self.line.append(text)
        self.space = False

    def indent(self, frames: int) -> int:
        return min(MOST_INDENT, self.frames[frames - 1][1] + width(self.frames[frames - 1][0])) if frames else 0

    def end(self, spaced: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False
        self.blank |= spaced

    def open(self, lead: str, spaced: bool) -> None:
        """Begins a frame; blank lines at its ends are those around it, not those that its content asks for."""
        self.end(spaced)
        self.frames.append([lead, self.indent(len(self.frames)), self.blank, False])
        self.blank = False

    def close(self, spaced: bool) -> None:
        self.end()
        _, _, due, begun = self.frames.pop()
        self.blank = spaced or (due and not begun)

    def result(self) -> list[str]:
        self.end()
        return self.done


def lay_out(root: Node, out: Lines, sheet: Sheet, seen: bool):
    """Lays out the content of an element. Yields the (cell, seen) of tables, to be sent their lines: a walk with stacks of
    its own, as pages may be nested to any depth."""
    todo = [(iter(root.children), root.tag, None, False, seen, None)]
    while todo:
        children, parent, ordered, pre, seen, leave = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            if leave:
                leave[0](leave[1])
            continue
        if isinstance(child, str):
            if not seen:
                continue
            if not pre:
                out.text(child)
                continue
            for i, line in enumerate(child.split("\n")):
                if i:
                    out.put("") if not out.line else None
                    out.end()
                if line:
                    out.put(line)
            continue
        laid, shows, display = sheet.shown(child, seen)
        if not laid:
            continue
        tag, inside = child.tag, iter(child.children)
        if tag == "br":
            out.put("") if shows and not out.line else None
            out.end()
        elif tag == "hr":
            out.end(True)
            if shows:
                out.put("---")
            out.end(True)
        elif tag == "img":
            out.text(child.attributes.get("alt", "") if shows else "")
        elif tag == "table":
            block(out, (yield from table_lines(child, sheet, shows)))
        elif tag in ("ul", "ol", "menu", "blockquote", "dd", "li"):
            start = re.fullmatch(r"\s*(-?\d{1,9})\s*", child.attributes.get("start", ""))
            lead = "  " if tag in ("blockquote", "dd") else "" if tag != "li" else f"{ordered[0]}. " if ordered else "- "
            if tag == "li" and ordered:
                ordered[0] += 1
            spaced = tag in SPACED and not (parent == "li" and tag in ("ul", "ol", "menu"))
            out.open(lead, spaced)
            todo.append((inside, tag, [int(start[1]) if start else 1] if tag == "ol" else None if tag in ("ul", "menu") else ordered, pre, shows, (out.close, spaced)))
        elif tag == "details" and "open" not in child.attributes:
            out.end()
            todo.append((iter([c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]), tag, ordered, pre, shows, (out.end, False)))
        elif (tag in BLOCK) if display is None else display not in INLINE:
            out.end(tag in SPACED)
            todo.append((inside, tag, ordered, pre or tag == "pre", shows, (out.end, tag in SPACED)))
        else:
            todo.append((inside, tag, ordered, pre or tag in ("textarea", "xmp"), shows, None))


def block(out: Lines, lines: list[str]) -> None:
    out.end(True)
    for line in lines:
        if line:
            out.put(line)
            out.end()
        else:
            out.end(True)
    out.end(True)


def number(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "1").strip()
    return min(int(text[:9]), most) if text.isdecimal() and text.isascii() else 1


def without(spans: list[tuple[int, int, float]], start: int, stop: int) -> list[tuple[int, int, float]]:
    """Spans of columns (start, stop, the row that is free again), without those from start to stop."""
    out = []
    for a, b, free in spans:
        out += [(x, y, free) for x, y in ((a, min(b, start)), (max(a, stop), b)) if x < y]
    return out


def merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """In order, neighbours that are free again together as one."""
    out: list[tuple[int, int, float]] = []
    for a, b, free in sorted(spans):
        if out and out[-1][1] == a and out[-1][2] == free:
            out[-1] = (out[-1][0], b, free)
        else:
            out.append((a, b, free))
    return out


def table_lines(node: Node, sheet: Sheet, seen: bool):
    """A table's caption, then its rows with cells aligned in columns. A cell may have several lines, span columns, and span
    rows to the end of its group; a place that it spans is left empty, and a column in which no cell begins takes no place.

    What is spanned is kept as intervals of columns. Where blanks would make a table over LOOSE times as long as its text
    with one mark a cell, and over LEAST_LOOSE characters, its cells stand one after the other instead, empty ones left out."""
    caption, grid, todo = [], [], [(node, seen, 0)]
    busy: list[tuple[int, int, float]] = []  # columns that the cells above still fill
    own_group, group, wide = 0, 0, {}
    while todo:
        n, seen, inside = todo.pop()
        if n.tag == "caption":
            caption += yield n, seen
            continue
        if n is node or n.tag in GROUPS:
            inner = [c if isinstance(c, Node) else Node("td", {}, [c]) for c in n.children if isinstance(c, Node) or SPACES.sub("", c)]
            group += 1
            todo += reversed([(c, shows, group if n is not node else inside) for c in inner for laid, shows, _ in [sheet.shown(c, seen)] if laid])
            continue
        cells = []
        for child in n.children if n.tag == "tr" else [n]:
            cell = child if isinstance(child, Node) and child.tag in ("td", "th") else Node("td", {}, [child])
            laid, shows, _ = sheet.shown(cell, seen)
            lines = (yield cell, shows) if laid else []
            if lines or (laid and cell is child):  # what is no cell, and shows nothing, takes no place
                cells.append((cell, lines or [""]))
        if n.tag != "tr" and not cells:
            continue
        row = len(grid)
        busy = [x for x in busy if x[2] > row] if own_group == inside else []
        own_group = inside
        line, at, after, k = {}, 0, busy, 0
        for cell, lines in cells:
            while k < len(busy) and busy[k][0] <= at:
                at, k = max(at, busy[k][1]), k + 1
            wide[at] = max(wide.get(at, 0), *map(width, lines))
            if any(lines):
                line[at] = lines
            rows, stop = number(cell, "rowspan", MOST_ROWS), at + max(1, number(cell, "colspan", MOST_COLUMNS))
            if rows != 1:
                after = [*without(after, at, stop), (at, stop, row + rows if rows else math.inf)]
            at = stop
        if after is not busy:
            busy = merged(after)
        grid.append((line, at if cells else 0))
    columns = sorted(wide)
    ends = [0]
    for c in columns:
        ends.append(ends[-1] + wide[c] + 3)
    shown = [(line, bisect.bisect_left(columns, end), max(map(len, line.values()), default=min(end, 1))) for line, end in grid]
    text = sum(len(x) + 3 for line, _, _ in shown for lines in line.values() for x in lines) + len(grid)
    loose = sum(ends[n] * high for _, n, high in shown) > max(LEAST_LOOSE, LOOSE * text)
    out = caption
    for line, n, high in shown:
        places = sorted(line) if loose else columns[:n]
        for k in range(high):
            cells = [lines[k] if k < len(lines := line.get(c, [""])) else "" for c in places]
            out.append(" | ".join(x for x in cells if x) if loose else " | ".join(x + " " * (wide[c] - width(x)) for c, x in zip(places, cells, strict=True)).rstrip())
    return out


def rendered(node: Node, sheet: Sheet) -> list[str]:
    """The element's lines."""
    out = Lines()
    walks, answer = [(lay_out(node, out, sheet, sheet.shown(node, True)[1]), out)], None
    while True:
        try:
            cell, seen = walks[-1][0].send(answer)
            answer, out = None, Lines()
            walks.append((lay_out(cell, out, sheet, seen), out))
        except StopIteration:
            answer = walks.pop()[1].result()
            if not walks:
                return answer


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    root, sheets = tree(page)
    return "\n".join(rendered(root, Sheet(sheets)))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the visible text of html_col as a browser would lay it out.

    - null html: null text; empty html or nothing visible: empty text.
    - unclosed, misplaced and stray tags never fail; elements may be nested to any depth.
    - long pages are read whole; repeated rows get the same text; a column named text, in any case, is replaced; an empty
      table stays so.
    """
    bounded_batches(pages.sparkSession)
    run = F.pandas_udf(lambda s: pd.Series([visible_text(x) for x in s], dtype=object), T.StringType())
    own = Carried(pages, html=html_col)
    return own.df.select("row", run("html").alias("out")).select(*own.columns({"text": F.col("out")}))


def op3_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")
