"""Layout-aware text of HTML pages.

`parse` reads tokens and builds a tree, with the tags that HTML lets writers leave out (a new paragraph, list item,
table row or cell ends the one before; blocks end a paragraph; what is left open at an end tag closes with it).
`Layout` walks the tree and writes what a reader would see: block boundaries as line breaks, an empty line around
paragraphs, bullets and numbers by list depth, preformatted text as it stands, tables with cells padded to columns.
All visible text is kept, navigation and footers too; what is hidden (scripts, styles, heads, templates, comments,
`hidden`, `display:none`, a closed `dialog`) is not; `aria-hidden` hides nothing from eyes, and buttons show their values.
`visibility` is inherited, and a visible element inside a hidden one shows.

A table's columns are as wide as their widest cell of up to WIDEST characters, and no gap in a row is wider than GAP, so
layout tables with one long cell, or with cells that span thousands of rows, do not grow: a page's text has at most some
fifty times the characters of the page.

Cases: null and empty pages give an empty text; broken markup never fails: a `<` that opens no tag is text, an
unclosed tag or comment at the end is dropped, a quote opens a value only after `=`, spans that are no number count as
one. Elements nested deeper than DEPTH have no boxes of their own: their text goes into the box around them, with a
line break at each block, and what one of them hides (for such depths with `visibility` too) stays hidden. A null
page_id stays null; repeated rows give repeated results; an empty table gives an empty result; other columns, whatever
their names, are ignored. Pages are rendered whole, in time linear in their length but for cells that span many rows,
which each row below steps over.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 100
#: A quote opens a value only after `=`; other values end at white space or `>`.
VALUE = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>{VALUE}|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: A declaration of a style; what quotes hold ends none and is none.
DECLARATION = re.compile(r"\s*([-\w]+)\s*:((?:[^;\"']|\"[^\"]*\"|'[^']*')*)")
WIDEST, GAP = 60, 120
#: The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title template noscript iframe object audio video canvas svg math datalist noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
PHRASE_END = BLOCKS - {"body", "html", "td", "th", "li", "tr", "caption"}
#: Start tag -> open elements that it ends, up to the nearest of the barriers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: An end tag never closes elements beyond these.
SCOPE = {"td", "th", "table", "html"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


class Tree:
    """The open elements of a page: those that have boxes, and those below DEPTH, which only tell what they hide."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.stack = [self.root]
        self.deep: list[tuple[str, bool]] = []
        self.open_deep: Counter[str] = Counter()
        self.hidden_deep = 0

    def text(self, text: str) -> None:
        if not self.hidden_deep:
            self.stack[-1].children.append(text)

    def cut(self, size: int) -> None:
        """Closes all boxes from the place `size` on, and all that is below DEPTH."""
        del self.stack[size:]
        self.cut_deep(0)

    def cut_deep(self, size: int) -> None:
        while len(self.deep) > size:
            tag, hides = self.deep.pop()
            self.open_deep[tag] -= 1
            self.hidden_deep -= hides

    def imply(self, tags: set[str], barriers: set[str]) -> None:
        """Closes the open elements of these tags, up to the nearest barrier."""
        k = len(self.stack) - 1
        while k > 0 and self.stack[k].tag not in barriers:
            if self.stack[k].tag in tags:
                self.cut(k)
            k -= 1

    def end(self, tag: str) -> None:
        if self.open_deep[tag]:
            k = len(self.deep) - 1
            while self.deep[k][0] != tag:
                k -= 1
            self.cut_deep(k)
            self.block(tag)
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.cut(k)
                return
            if self.stack[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def block(self, tag: str) -> None:
        if tag in BLOCKS and not self.hidden_deep:
            self.stack[-1].children.append(Node("div", {}))

    def start(self, node: Node, closed: bool) -> None:
        if len(self.stack) < DEPTH:
            self.stack[-1].children.append(node)
            if not closed:
                self.stack.append(node)
            return
        if closed:
            if not self.hidden_deep:
                self.stack[-1].children.append(node)
            return
        self.block(node.tag)
        hides = not visible(node) or visibility(node, True) is False
        self.deep.append((node.tag, hides))
        self.open_deep[node.tag] += 1
        self.hidden_deep += hides


def parse(page: str) -> Node:
    tree = Tree()
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            tree.text(html.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in tree.stack) and not tree.open_deep["p"]:
                tree.stack[-1].children.append(Node("p", {}))
            tree.end(tag)
            continue
        if tag in IMPLIED:
            tree.imply(*IMPLIED[tag])
        elif tag in PHRASE_END:
            tree.imply({"p"}, {"td", "th", "table", "button"})
        if tag in ("html", "body") and any(n.tag == tag for n in tree.stack):
            continue
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /\n\t\r\f") else {})
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(page)
        tree.start(node, tag in RAW or tag in VOID or m[3].endswith("/") and tag not in BLOCKS)
    return tree.root


def declared(style: str) -> dict[str, str]:
    """Properties of a style attribute; the last of one name counts."""
    return {m[1].lower(): m[2].replace("!important", "").strip().lower() for m in DECLARATION.finditer(style)}


def visible(node: Node) -> bool:
    """Whether an element has a box at all."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return False
    if node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset"):
        return False
    return not ("style" in a and declared(a["style"]).get("display") == "none")


def visibility(node: Node, inherited: bool) -> bool:
    """Whether an element's own text shows: the `visibility` of its style, else what the box around it has."""
    said = declared(node.attrs["style"]).get("visibility") if "style" in node.attrs else None
    return said == "visible" if said in ("visible", "hidden", "collapse") else inherited


class Layout:
    """Lines of a rendered box. Breaks are held back until text follows, so boundaries never pile up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.breaks = 0
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, raw: str) -> None:
        words = raw.split()
        if not words:
            if self.parts and raw:
                self.parts.append(" ")
            return
        self._settle()
        lead, tail = raw[0].isspace(), raw[-1].isspace()
        self.parts.append((" " if lead and self.parts else "") + " ".join(words) + (" " if tail else ""))

    def _settle(self) -> None:
        if self.breaks:
            self._end_line()
            if self.breaks > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.breaks = 0
        if not self.parts:
            self.parts.append("".join(self.prefix[:-1] if self.marker else self.prefix) + self.marker if self.prefix or self.marker else "")
            self.marker = ""

    def _end_line(self) -> None:
        line = re.sub(r"(?<=\S) +", " ", "".join(self.parts)).rstrip()
        if line:
            self.lines.append(line)
        self.parts = []

    def block(self, spaced: bool = False) -> None:
        self.breaks = max(self.breaks, 2 if spaced else 1)

    def newline(self) -> None:
        self._settle()
        self._end_line()

    def verbatim(self, lines: list[str]) -> None:
        for line in lines:
            self._settle()
            self.lines.append("".join(self.parts) + line.rstrip())
            self.parts = []

    def finish(self) -> list[str]:
        self._end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _raw_text(node: Node, seen: bool) -> str:
    return "".join((c if seen else "") if isinstance(c, str) else "\n" if c.tag == "br" else _raw_text(c, visibility(c, seen)) if visible(c) else "" for c in node.children)


def render(node: Node, out: Layout, seen: bool = True) -> None:
    number = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.text(child)
            continue
        if not visible(child):
            continue
        tag, shown = child.tag, visibility(child, seen)
        if tag == "br":
            out.newline()
        elif tag == "img":
            if shown and child.attrs.get("alt", "").strip():
                out.text(child.attrs["alt"])
        elif tag == "input":
            if shown:
                out.text(child.attrs.get("value", ""))
        elif tag == "table":
            out.block(True)
            out.verbatim(table_lines(child, shown))
            out.block(True)
        elif tag == "pre":
            out.block(True)
            out.verbatim(_raw_text(child, shown).strip("\n").split("\n"))
            out.block(True)
        elif tag == "li":
            out.block()
            mark = "- "
            if node.tag == "ol":
                if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                    number = int(child.attrs["value"])
                mark, number = f"{number}. ", number + 1
            out.marker = mark if shown else ""
            out.prefix.append(" " * len(mark))
            render(child, out, shown)
            out.prefix.pop()
            out.marker = ""
            out.block()
        elif tag == "blockquote":
            out.block(True)
            out.prefix.append("> ")
            render(child, out, shown)
            out.block(True)
            out.prefix.pop()
        elif tag in BLOCKS:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and out.prefix)
            out.block(spaced)
            render(child, out, shown)
            out.block(spaced)
        else:
            render(child, out, shown)


def _span(cell: Node, name: str, most: int) -> int:
    said = re.match(r"\s*\+?([0-9]+)", cell.attrs.get(name, ""))
    return min(int(said[1][:6]), most) if said else 1


def table_lines(table: Node, seen: bool = True) -> list[str]:
    """Rows of a table, each cell padded to its column's width; cells of several lines take several lines, and a cell
    that spans rows keeps its columns free in the rows below."""
    rows: list[dict[int, list[str]]] = []
    caption: list[str] = []
    loose = Node("div", {})
    taken: list[tuple[int, int, int]] = []  # first column, column after the last, last row

    def walk(node: Node, seen: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if seen and child.strip():
                    loose.children.append(child)
            elif not visible(child):
                continue
            elif child.tag == "tr":
                row(child, visibility(child, seen))
            elif child.tag in ("tbody", "thead", "tfoot"):
                taken.clear()
                walk(child, visibility(child, seen))
                taken.clear()
            elif child.tag == "caption":
                caption.extend(lines_of(child, visibility(child, seen)))
            else:
                loose.children.append(child)

    def row(node: Node, seen: bool) -> None:
        here = [t for t in taken if t[2] >= len(rows)]
        cells: dict[int, list[str]] = {}
        column = next_taken = 0
        new = []
        for cell in node.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and visible(cell):
                while next_taken < len(here) and here[next_taken][0] <= column:
                    column = max(column, here[next_taken][1])
                    next_taken += 1
                cells[column] = lines_of(cell, visibility(cell, seen))
                width, height = max(1, _span(cell, "colspan", MOST_COLUMNS)), _span(cell, "rowspan", MOST_ROWS)
                if height != 1:  # 0 is all rows to the end of the group
                    new.append((column, column + width, len(rows) + (height or MOST_ROWS) - 1))
                column += width
            elif isinstance(cell, Node) and visible(cell) or seen and isinstance(cell, str) and cell.strip():
                loose.children.append(cell)
        taken[:] = sorted([*here, *new])
        if cells:
            rows.append(cells)

    walk(table, seen)
    columns = sorted({k for r in rows for k in r})
    widths = {k: 0 for k in columns}
    for r in rows:
        for k, cell in r.items():
            widths[k] = max(widths[k], *(len(c) for c in cell if len(c) <= WIDEST), 0)
    starts = dict(zip(columns, accumulate((widths[k] + 2 for k in columns), initial=0)))
    out = caption + lines_of(loose, seen)
    for r in rows:
        left = sorted(r)
        for n in range(max(map(len, r.values())) or 1):
            left = [k for k in left if n < len(r[k])]
            line, end = [], 0
            for k in left:
                if r[k][n]:
                    at = max(starts[k], end + 2) if line else starts[k]
                    line += [" " * min(at - end, GAP), r[k][n]]
                    end = at + len(r[k][n])
            out.append("".join(line).rstrip())
    return out


def lines_of(node: Node, seen: bool = True) -> list[str]:
    inner = Layout()
    render(node, inner, seen)
    return inner.finish()


def page_text(page: str | None) -> str:
    return "\n".join(lines_of(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_chars, text) of each row of pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [page_text(p.as_py()) for p in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["page_id", "n_chars", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(work, f"page_id {rows.schema['page_id'].dataType.simpleString()}, n_chars bigint, text string")
