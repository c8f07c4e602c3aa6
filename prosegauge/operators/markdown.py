"""Structure of one Markdown document, for documents that can't be cut at blank lines.

Which block a line belongs to depends on the lines before it in ways that windows can't follow (a fence ends only at
its own kind of mark, quotes and items nest, markup may hide lines), so this small reader goes through a document once.
`Outline` finds blocks, `Inline` what a reader sees within one. Both are linear in the text: each line and each token
is looked at once, and every repeat in a pattern is possessive or bounded. The rules themselves are Spark expressions
over what this returns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

#: Marks code spans for the sentence splitter: a stop in front of it ends no sentence.
GUARD = "\x04"

QUOTE = re.compile(r" {0,3}>[ \t]?")
ITEM = re.compile(r"( {0,3}(?:[-*+]|(\d{1,9})[.)]))([ \t]+|$)")
TASK = re.compile(r"\[[ xX]\][ \t]+")
#: What a line begins, by the name of the group; the first that fits counts.
BEGINS = re.compile(
    r"(?P<hush> {0,3}(?:<!--|<\?|<![A-Z]))"
    r"|(?P<fence> {0,3}(?P<marks>`{3,}(?=[^`]*+$)|~{3,}))"
    r"|(?P<atx> {0,3}(?P<level>#{1,6})(?:[ \t]+(?P<title>.*))?$)"
    r"|(?P<under> {0,3}(?:=++|-++)[ \t]*+$)"
)
#: Characters that begin none of these, nor a quote, an item, a rule or a definition. Only lines that begin with others
#: are held against the patterns.
DULL = frozenset(map(chr, range(33, 127))) - frozenset("<`~#=-*+_>[0123456789")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*+\1){2,}+[ \t]*+$")
UNDER = re.compile(r" {0,3}(?:=++|-++)[ \t]*+$")
#: A line that begins one of these can't carry on a paragraph outside its quote or item.
BREAKS_IN = re.compile(r" {0,3}(?:#{1,6}(?:[ \t]|$)|`{3}|~{3}|>|[-*+](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$)|([-*_])(?:[ \t]*+\1){2,}+[ \t]*+$)")
ENDS_TABLE = re.compile(r" {0,3}(?:<[a-zA-Z/!?]|#{1,6}[ \t])| {4}|" + RULE.pattern)
ALERT = re.compile(r"\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]", re.I)
ESCAPE = r"\\[!-/:-@\[-`{-~]"
DEFINITION = re.compile(
    rf" {{0,3}}\[(?P<label>(?!\^)(?:{ESCAPE}|\\.|[^\]\[\\]){{1,999}}+)\]: *+(?P<to><(?:{ESCAPE}|[^<>])*+>|(?!<)(?:{ESCAPE}|[^ \t\\]|\\)++)(?: ++(?:\"[^\"]*+\"|'[^']*+'|\([^)]*+\)) *+| *+)$"
)
YAML = re.compile(r"\s*$|[ \t]|#|- |(?:['\"][^'\"]*+['\"]|[^:\s]++)[ \t]*+:(?: |$)")
FRONT_END = re.compile(r"(?:---|\.\.\.)[ \t]*+$")


def balanced(destination: str) -> bool:
    depth = 0
    for mark in re.findall(r"\\.|[()]", destination):
        depth += (mark == "(") - (mark == ")")
        if not 0 <= depth <= 32:
            return False
    return depth == 0


def cells(row: str) -> int:
    """Columns of a table row; escaped pipes cut nothing and outer pipes count as none."""
    parts = re.sub(r"\\.", "..", row).split("|")
    return len(parts) - (not parts[0].strip()) - (len(parts) > 1 and not parts[-1].strip())


def is_divider(row: str) -> bool:
    if ITEM.match(row):
        return False
    return all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in row.removeprefix("|").removesuffix("|").split("|"))


def normal(label: str) -> str:
    """The form in which labels of references are compared."""
    return " ".join(re.sub(rf"\\([!-/:-@\[-`{{-~])", r"\1", label).split()).lower()


def after_markup(text: str, close: str) -> str | None:
    """What follows the end of invisible markup, or None where it does not end."""
    ends = [(at, len(c)) for c in ((close, "--!>") if close == "-->" else (close,)) if (at := text.find(c)) >= 0]
    return text[sum(min(ends)) :] if ends else None


class Outline:
    """Blocks of a document. view holds, line by line, what line rules read: None where a line is hidden."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.view: list[str | None] = list(lines)
        self.paragraphs: list[tuple[int, list[str]]] = []  # first line, lines
        self.headings: list[tuple[int, int, str]] = []  # level, line, source
        self.labels: set[str] = set()
        self.boxes: list[int] = []  # open quotes (0) and list items (the column of their content)
        self.open: tuple[int, list[str]] | None = None  # the paragraph that may go on
        self.depth = 0
        self.fence = ""
        self.hush: tuple[str, int] | None = None  # what ends invisible markup, and the boxes that hold it
        at = self.front_matter()
        while at < len(lines):
            at = self.read(at)

    def front_matter(self) -> int:
        if not self.lines[0].startswith("---") or not re.match(r"---[ \t]*+$", self.lines[0]):
            return 0
        end = next((k for k, line in enumerate(self.lines) if k and FRONT_END.match(line)), None)
        if end is None or not all(YAML.match(line) for line in self.lines[1:end]):
            return 0
        self.view[: end + 1] = [None] * (end + 1)
        return end + 1

    def inside(self, line: str) -> tuple[str, int]:
        """A line without the marks of the open boxes that still hold it, and the number of these. The line is cut once:
        `at` is where the boxes so far end, `edge` the next place that is no blank."""
        if not self.boxes:
            return line, 0
        end, size = len(line.rstrip()), len(line)
        at, edge = 0, size - len(line.lstrip(" "))
        for k, column in enumerate(self.boxes):
            if column == 0:
                mark = QUOTE.match(line, at)
                if not mark:
                    return line[at:], k
                at = edge = mark.end()
                while edge < size and line[edge] == " ":
                    edge += 1
            elif edge < end:
                if edge - at < column:
                    return line[at:], k
                at += column
        return line[at:], len(self.boxes)

    def leave(self, held: int) -> None:
        self.open = None
        del self.boxes[held:]

    def enter(self, text: str) -> tuple[str, bool]:
        """Opens the quotes and items that a line begins; the text in them, and whether a quote was opened."""
        quoted = False
        while True:
            if mark := QUOTE.match(text):
                self.open, quoted = None, True
                self.boxes.append(0)
                text = text[mark.end() :]
                continue
            mark = ITEM.match(text)
            if not mark or RULE.match(text) or self.open and UNDER.match(text):
                return text, quoted
            # Within a paragraph only a bullet or number 1 with text behind it begins a list.
            if self.open and (not text[mark.end() :].strip() or mark[2] not in (None, "1")):
                return text, quoted
            # More than four blanks belong to code in the item, all but one.
            width = mark.end() if len(mark[3]) <= 4 else mark.end(1) + 1
            self.open = None
            self.boxes.append(width)
            text = text[width:]
            if task := TASK.match(text):
                text = text[task.end() :]

    def read(self, at: int) -> int:
        """Reads the line at a place and returns the place of the next."""
        text, held = self.inside(self.lines[at].expandtabs(4)) if self.boxes or "\t" in self.lines[at] else (self.lines[at], 0)
        whole = held == len(self.boxes)
        if self.hush:
            close, depth = self.hush
            if held < depth:  # markup can't go on outside the box that holds it
                self.hush = None
                self.leave(held)
                whole = True
            else:
                rest = after_markup(text, close)
                self.view[at] = rest or ""
                if rest is None:
                    return at + 1
                self.hush = None
                text = rest
        if self.fence:
            if whole:
                mark = BEGINS.match(text)
                if mark and mark["fence"] and mark["marks"].startswith(self.fence) and not text[mark.end() :].strip():
                    self.fence = ""
                self.view[at] = None
                return at + 1
            self.fence = ""
            self.leave(held)
            whole = True
        if not text.strip():
            self.leave(held)
            return at + 1
        dull = text.lstrip(" ")[0] in DULL
        lazy = not whole and self.open is not None and (dull or not BREAKS_IN.match(text))
        quoted = False
        if not lazy:
            if not whole:
                self.leave(held)
            if not dull:
                text, quoted = self.enter(text)
        if quoted and len(self.boxes) == 1 and ALERT.fullmatch(text.strip()):
            return at + 1
        return self.block(at, text, lazy)

    def block(self, at: int, text: str, lazy: bool) -> int:
        if text.lstrip(" ")[:1] in DULL:
            return self.prose(at, text)
        begins = BEGINS.match(text)
        if begins and begins["hush"]:
            text = self.markup(text)
            self.open = None
            self.view[at] = text
            if not text.strip():
                return at + 1
            begins = BEGINS.match(text)
        kind = next((k for k in ("fence", "atx", "under") if begins and begins[k] is not None), "")
        if not self.open and "[" in text and "\t" not in self.lines[at] and (named := DEFINITION.match(text)) and named["label"].strip() and (named["to"][0] == "<" or balanced(named["to"])):
            self.labels.add(normal(named["label"]))
            self.view[at] = ""
            return at + 1
        if kind == "fence":
            self.open, self.fence, self.view[at] = None, begins["marks"], None
            return at + 1
        if kind == "atx":
            title = (begins["title"] or "").rstrip()
            bare = title.rstrip("#")
            if bare != title and bare[-1:].isspace():
                title = bare
            self.open = None
            self.headings.append((len(begins["level"]), at + 1, title.strip()))
            return at + 1
        if kind == "under" and not lazy and self.open and self.depth == len(self.boxes):
            line, body = self.open
            self.paragraphs.pop()
            self.headings.append((1 if text.lstrip()[0] == "=" else 2, line, " ".join(body).strip()))
            self.open = None
            return at + 1
        if RULE.match(text):
            self.open = None
            return at + 1
        return self.prose(at, text)

    def prose(self, at: int, text: str) -> int:
        """A line that begins nothing of its own: of a paragraph, a table or indented code."""
        if not self.open and text.startswith("    "):
            return at + 1  # indented code: no paragraph, but line rules see it
        if "|" in text and (below := self.next_inside(at)) is not None and "-" in below and cells(text.strip()) == cells(below.strip()) and is_divider(below.strip()):
            return self.table(at, text, below)
        if not self.open:
            self.open = (at + 1, [])
            self.depth = len(self.boxes)
            self.paragraphs.append(self.open)
        self.open[1].append(text.lstrip())
        return at + 1

    def markup(self, text: str) -> str:
        """A line that begins with invisible markup, without it."""
        start = len(text) - len(text.lstrip(" "))
        comment = text.startswith("<!--", start)
        body = text[start + (4 if comment else 2) :]
        if comment and body.startswith((">", "->")):
            return text[:start] + " " + body[body.index(">") + 1 :]
        close = "-->" if comment else ">"
        rest = after_markup(body, close)
        if rest is None:
            self.hush = (close, len(self.boxes))
            return text[:start]
        return text[:start] + " " + rest

    def next_inside(self, at: int) -> str | None:
        if at + 1 >= len(self.lines):
            return None
        text, held = self.inside(self.lines[at + 1].expandtabs(4))
        return text if held == len(self.boxes) else None

    def table(self, at: int, text: str, below: str) -> int:
        self.open = None
        self.view[at], self.view[at + 1] = text, below
        at += 1
        while (row := self.next_inside(at)) is not None and "|" in row and not ENDS_TABLE.match(row):
            at += 1
            self.view[at] = row
        return at + 1


class Link(NamedTuple):
    start: int
    close: int  # place of the bracket that ends the label
    end: int
    image: bool
    kind: str
    label: str
    whole: bool  # the label is not cut
    target: str
    shown: bool  # not within the text of an image


#: Labels up to this length are kept as they are. Of longer ones, of which a text of nested links has many, what shows
#: is cut after so many characters, unless it is an address: rules read no more of them.
LABEL, SHOWN = 1000, 64
#: What a reader does not see of a label, as well as blanks.
UNSEEN = re.compile(r"(?:[*_~`\s]|<(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|&nbsp;|&#0*160;|&#x0*a0;)++", re.I)
MARKS = re.compile(r"[*_~`\s]+|&nbsp;|&#0*160;|&#x0*a0;", re.I)
ADDRESS = re.compile(r"<?(?:https?://|www\.)", re.I)


def label_of(text: str, start: int, close: int) -> tuple[str, bool]:
    """A link's label and whether it is whole."""
    if close - start <= LABEL:
        return text[start:close], True
    lead = UNSEEN.match(text, start, close)
    at = lead.end() if lead else start
    if ADDRESS.match(text, at, close):
        return text[start:close], True
    window = text[at : min(close, at + 4 * SHOWN)]
    if "<" not in window and len(MARKS.sub("", window)) > SHOWN:
        return window, False
    shown = 0
    while at < close and shown <= SHOWN:
        shown += 1
        at += 1
        if lead := UNSEEN.match(text, at, close):
            at = lead.end()
    return text[start:at] if shown <= SHOWN else text[start:at][-4 * SHOWN :], shown <= SHOWN


#: Texts in which each bracket is closed on its line before the next is opened, and each destination before that.
LEVEL = re.compile(r"(?:[^\[\]]++|\[[^\[\]\n]*+\](?!\()|\[[^\[\]\n]*+\]\([^\[\]()\n]*+\))*+")


def links(text: str) -> list[Link]:
    """Links and images of a text whose escapes and code are blanked, in order. A destination ends at the first `)`;
    brackets in it are no labels."""
    partner: dict[int, int] = {}
    to: dict[int, int] = {}
    waiting: list[int] = []
    skip = 0
    last = text.rfind(")")
    for m in re.finditer(r"[\[\]]", text):
        at = m.start()
        if at < skip:
            continue
        if m[0] == "[":
            waiting.append(at)
        elif waiting:
            partner[waiting.pop()] = at
            if text.startswith("(", at + 1) and last > at:
                to[at] = text.index(")", at + 2)
                skip = to[at] + 1
    found: list[Link] = []
    around: list[Link] = []
    past = images = 0
    for start in sorted(partner):
        close = partner[start]
        while around and around[-1].end <= start:
            images -= around.pop().image
        if start < past or around and start > around[-1].close:
            continue
        image = text.startswith("!", start - 1) if start else False
        kind, end, target = "shortcut", close + 1, ""
        if close in to:
            kind, end, target = "inline", to[close] + 1, text[close + 2 : to[close]]
        elif text.startswith("[", close + 1) and close + 1 in partner:
            end = partner[close + 1] + 1
            kind, target = "reference", text[close + 2 : end - 1]
        elif text.startswith(("(", "["), close + 1):
            continue
        link = Link(start - image, close, end, image, kind, *label_of(text, start + 1, close), target, not images)
        found.append(link)
        if kind == "shortcut":
            past = end
        else:
            around.append(link)
            images += image
    return found


def names(link: Link) -> str | None:
    """The reference that a link names, in its normal form. No definition has a label as long as those that are cut."""
    named = link.target if link.kind == "reference" else ""
    return normal(named) if named else normal(link.label) if link.whole else None


TAG = r"</[A-Za-z][A-Za-z0-9-]*+[ \t\n]*+>|<[A-Za-z][A-Za-z0-9-]*+(?:[ \t\n]++[A-Za-z_:][A-Za-z0-9_.:-]*+(?:[ \t\n]*+=[ \t\n]*+(?:[^ \t\n\"'=<>`]++|'[^']*+'|\"[^\"]*+\"))?+)*+[ \t\n]*+/?>"
TOKEN = re.compile(rf"(?P<escape>{ESCAPE})|(?P<ticks>`+)|(?P<tag>{TAG})|(?P<hush><!--|<\?|<![A-Z])")
BLANKED = str.maketrans("!<>[]()", " " * 7)
STOP_IN_CODE = re.compile(r"([.!?][*_`\"'’”)\]}]*+)(?=\s)")


class Inline:
    """What stands in a paragraph: for readers (with escapes resolved unless kept), for line rules (no tags) and for
    rules on tags. mask is as long as the readers' text, with all blanked that can't be part of a link."""

    def __init__(self, source: str, keep_escapes: bool = False) -> None:
        self.reader = self.mask = self.view = self.tags = source
        if "\\" in source or "`" in source or "<" in source:
            self.look(source, keep_escapes)

    def look(self, source: str, keep_escapes: bool) -> None:
        reader: list[str] = []
        mask: list[str] = []
        view: list[str] = []
        tags: list[str] = []
        runs: dict[int, list[int]] = {}
        for m in re.finditer(r"`+", source):
            runs.setdefault(len(m[0]), []).append(m.start())
        for places in runs.values():
            places.reverse()
        nearest: dict[str, int] = {}

        def find(close: str, body: int) -> int:
            """The first place of a closing mark from body on; -1 if none is left. Bodies only grow."""
            if nearest.get(close, 0) != -1 and nearest.get(close, -2) < body:
                nearest[close] = source.find(close, body)
            return nearest[close]

        def put(r: str, k: str, v: str, t: str) -> None:
            reader.append(r), mask.append(k), view.append(v), tags.append(t)

        at = 0
        while m := TOKEN.search(source, at):
            plain = source[at : m.start()]
            put(plain, plain, plain, plain)
            at = m.end()
            if m["escape"]:
                shown = m[0] if keep_escapes else m[0][1]
                put(shown, " " * len(shown), "  ", "  ")
            elif m["ticks"]:
                size = len(m[0])
                places = runs.get(size, [])  # a run whose first mark is escaped is a shorter one
                while places and places[-1] < at:
                    places.pop()
                if not places:
                    put(m[0], m[0], m[0], m[0])
                    continue
                inner = source[at : places[-1]]
                span = f"{m[0]}{STOP_IN_CODE.sub(rf'\1{GUARD}', inner)}{m[0]}{GUARD if inner else ''}"
                flat = " " * size + inner.translate(BLANKED) + " " * size
                put(span, re.sub(r"[^\n]", " ", span), flat, flat)
                at = places[-1] + size
            elif m["tag"]:
                kept = " " + "\n" * m[0].count("\n")
                put(kept, kept, kept, m[0])
            else:
                size = 4 if m[0] == "<!--" else 2
                body = m.start() + size
                if size == 4 and source.startswith((">", "->"), body):
                    put(" ", " ", " ", " ")
                    at = source.index(">", body) + 1
                    continue
                close = ("-->", "--!>") if size == 4 else (">",)
                found = min(((find(c, body), len(c)) for c in close if find(c, body) >= 0), default=None)
                if found is None:
                    put(m[0], m[0], m[0], m[0])
                    continue
                at = sum(found)
                kept = " " + "\n" * source.count("\n", m.start(), at)
                put(kept, kept, kept, kept)
        rest = source[at:]
        put(rest, rest, rest, rest)
        self.reader, self.mask, self.view, self.tags = map("".join, (reader, mask, view, tags))

    def flat(self, labels: set[str]) -> str:
        """The readers' text with links cut down to their labels; line ends of what is cut stay behind the label."""
        if "]" not in self.mask or "](" not in self.mask and not labels:
            return self.reader
        cuts = []
        for link in links(self.mask):
            if link.kind == "inline" or labels and names(link) in labels:
                first = link.start + link.image + 1
                cuts += [(link.start, first, ""), (link.close, link.end, "\n" * self.mask.count("\n", link.close, link.end))]
        out, at = [], 0
        for a, b, kept in sorted(cuts):
            out += [self.reader[at:a], kept]
            at = b
        return "".join([*out, self.reader[at:]])


#: White space beyond ASCII.
RARE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _plainer(x):  # noqa: ANN001, ANN202
    if isinstance(x, str):
        return RARE.sub(" ", x)
    if isinstance(x, list):
        return [_plainer(y) for y in x]
    return {k: _plainer(y) for k, y in x.items()} if isinstance(x, dict) else x


def structure(text: str) -> dict:
    """blocks (line, text) for readers, headings (line, level, text), rows (line, text) of the line view without hidden
    lines, links (line, at, image, kind, label, target) whose references are defined, and markup, the view with tags."""
    outline = Outline(text.split("\n"))
    tags = list(outline.view)
    blocks = []
    for line, body in outline.paragraphs:
        inline = Inline("\n".join(body))
        for k, (v, t) in enumerate(zip(inline.view.split("\n"), inline.tags.split("\n"))):
            outline.view[line - 1 + k], tags[line - 1 + k] = v, t
        blocks.append({"line": line, "text": inline.flat(outline.labels)})
    found = []

    def add(line: int, at: int, link: Link) -> None:
        target = link.target.strip()
        label = link.label.strip()
        if link.kind == "inline":
            if not target:
                return
        else:
            if not outline.labels or names(link) not in outline.labels:
                return
            target = target or label if link.kind == "reference" else label
        found.append({"line": line, "at": at, "image": link.image, "kind": link.kind, "label": link.label, "target": link.target if link.kind == "inline" else target})

    for k, v in enumerate(outline.view):
        if v and "]" in v and ("](" in v or outline.labels):
            for link in links(v):
                if link.shown:
                    add(k + 1, link.start, link)
    markup = "\n".join(t or "" for t in tags)
    if "](" in markup and not LEVEL.fullmatch(markup):
        line = past = 0
        ends = [m.start() for m in re.finditer("\n", markup)]
        gaps = [m.span(1) for m in re.finditer(r"(?=(\n[ \t]*+\n))", markup)]
        crosses = lambda link: (k := bisect_left(ends, link.start)) < len(ends) and ends[k] < link.close
        broken = lambda link: (k := bisect_left(gaps, (link.start, 0))) < len(gaps) and gaps[k][1] <= link.end
        for link in links(markup):
            line += markup.count("\n", past, link.start)
            past = link.start
            if link.shown and not link.image and link.kind == "inline" and crosses(link) and "\n" not in link.target and not broken(link):
                add(line + 1, (1 << 30) + link.start, link)
    out = {
        "blocks": blocks,
        "headings": [{"line": line, "level": level, "text": Inline(source, keep_escapes=True).flat(outline.labels)} for level, line, source in outline.headings],
        "rows": [{"line": k + 1, "text": v} for k, v in enumerate(outline.view) if v is not None],
        "links": found,
        "markup": markup if "<" in markup else "",
    }
    return _plainer(out) if RARE.search(text) else out
