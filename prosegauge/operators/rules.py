"""The mechanical rules. Each is a column over a parsed document (`prosegauge.operators.structure.parsed`): an array of
struct<line, detail, ord> with the rule's findings in that document, ord being their order within the rule.

All rules but the acronym rule are worked out side by side in one projection, so an audit scans a corpus once and
moves nothing until findings come out. Texts are tested for a rule's first condition before anything is cut up, and
arrays that several findings need are made once (`let`), so that work stays linear in the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.functions.text import AFTER, BEFORE, WS, let, newlines, occurrences, phrase_pattern, squash, to_fixed_1, trim_ws, without_named, words_in
from prosegauge.operators.sentences import marked, n_fewest

LIMITS = lex.THRESHOLDS
FINDING = "array<struct<line:int,detail:string,ord:bigint>>"


def finding(line: Column, detail: Column, ord_: Column | None = None) -> Column:
    return F.struct(line.cast("int").alias("line"), detail.alias("detail"), (line if ord_ is None else ord_).cast("bigint").alias("ord"))


def place(line: Column, at: Column) -> Column:
    """An order by line, then by place within it."""
    return F.shiftleft(line.cast("bigint"), 32) + at.cast("bigint")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def joined(*found: Column) -> Column:
    """Findings of several kinds, one after the other: concat takes longer over arrays."""
    return F.flatten(F.array(*found))


def each(array: Column | str, one: Callable[[Column], Column]) -> Column:
    """The findings of all elements, one after the other."""
    return F.flatten(F.transform(array, one))


def optional(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(FINDING))


# Sentences. `marks` has, for each block, what `measured` tells of it.


def sentence_length() -> Column:
    limit = LIMITS["sentenceWordLimit"]

    def of_block(b: Column) -> Column:
        line = b.getField("line")
        counted = F.transform(b.getField("sentences"), lambda x, i: F.struct(x.getField("n").alias("n"), x.getField("at").alias("at"), i.alias("i")))
        long = F.filter(counted, lambda x: x.getField("n") > limit)
        return F.transform(long, lambda x: finding(line + x.getField("at"), _text(x.getField("n"), f" words (limit {limit})"), place(line, x.getField("i"))))

    return each("marks", of_block)


def paragraph_length() -> Column:
    limit = LIMITS["paragraphSentenceLimit"]
    long = F.filter("marks", lambda b: b.getField("few") > limit)
    return F.transform(long, lambda b: finding(b.getField("line"), _text(b.getField("few"), f" sentences (limit {limit})")))


def sentence_average() -> Column:
    """Both readings must be above the limit; the one with most sentences is reported. They have the same words, of
    which each stands in a sentence."""
    least, limit = LIMITS["averageMinimumSentences"], LIMITS["sentenceAverageLimit"]

    def total(count: Callable[[Column], Column]) -> Column:
        return F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, b: a + count(b))

    def judge(c: Column) -> Column:
        n, m = c.getField("most"), c.getField("fewest")
        detail = lambda w: _text("average ", to_fixed_1(w, n), " words across ", n, f" sentences (limit {limit})")
        return optional((n >= least) & (m >= least), let(total(words), lambda w: optional((w > limit * n) & (w > limit * m), F.array(finding(F.lit(1), detail(w))))))

    words = lambda b: F.aggregate(b.getField("sentences"), F.lit(0).cast("bigint"), lambda a, x: a + x.getField("n"))
    return let(F.struct(total(lambda b: F.size(b.getField("sentences"))).alias("most"), total(lambda b: b.getField("few")).alias("fewest")), judge)


# Phrases. `said` has those that the first look told (`prosegauge.operators.said`), `hot` the blocks with phrases in
# which patterns have to look for them: few, in most corpora none.

#: Rule -> its phrases; their numbers here are the kinds in `said`.
SAID_BY = {"legalese": lex.LEGALESE, "double-negative": lex.DOUBLE_NEGATIVES, "wordy-phrase": tuple(lex.WORDY), "doublet": tuple(lex.DOUBLETS), "complex-word": tuple(lex.COMPLEX_WORDS)}
SAID = "array<struct<line:int,kind:int,k:int,i:int,phrase:string>>"

#: A complex word is a whole run of letters and apostrophes, so one in the genitive is another word.
COMPLEX = f"(?i)(?<![A-Za-z'])({'|'.join(lex.COMPLEX_WORDS)})(?![A-Za-z'])"
ANY_PHRASE = phrase_pattern((*lex.LEGALESE, *lex.DOUBLE_NEGATIVES, *lex.WORDY, *lex.DOUBLETS)) + "|" + COMPLEX


def _places(text: Column, pattern: str, build: Callable[[Column, Column, Column], Column]) -> Column:
    """build(phrase, line ends before it, number) for each match, in order. A mark before each match gives the line."""

    def cut(m: Column) -> Column:
        begun = F.flatten(F.transform(F.split(m, "\n"), lambda l, k: F.array_repeat(k, occurrences(l, "\x01"))))  # noqa: E741
        pieces = F.split(m, "\x01")
        phrases = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.substring_index(p, "\x02", 1))
        numbered = F.zip_with(begun, phrases, lambda k, p: F.struct(k.alias("k"), p.alias("p")))
        return F.transform(numbered, lambda x, i: build(x.getField("p"), x.getField("k"), i))

    return let(F.regexp_replace(text, pattern, "\x01$1\x02"), cut)


def _told(rule: str, build: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """build(phrase, line of its block, line ends before it, number) for each phrase that the first look told."""
    of = F.filter("said", lambda x: x.getField("kind") == list(SAID_BY).index(rule))
    return F.transform(of, lambda x: build(*(x.getField(f) for f in ("phrase", "line", "k", "i"))))


def _either(of_block: Callable[[Column], Column], told: Column) -> Column:
    """A text has hot blocks or phrases that were told."""
    return F.when(F.size("hot") > 0, each("hot", of_block)).otherwise(told)


def _phrases(rule: str, phrases: list[str], build: Callable[[Column, Column, Column], Column], by_line: bool = False, pattern: str | None = None) -> Column:
    """Findings of phrases in the hot blocks. A phrase that quotes hold alone is named and not used; named spans are
    looked for in a line or in a whole block, as the rule reads it."""
    pattern = pattern or phrase_pattern(phrases)

    def of_block(b: Column) -> Column:
        text = b.getField("text")
        used = F.array_join(F.transform(F.split(text, "\n"), lambda l: without_named(l, phrases)), "\n") if by_line else without_named(text, phrases)  # noqa: E741
        return optional(text.rlike(pattern), _places(used, pattern, lambda p, k, i: build(p, b.getField("line") + k, i)))

    return _either(of_block, _told(rule, lambda p, line, k, i: build(p, line + k, i)))


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def _number(values: list[str], c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(v) for v in values)), c)


def legalese() -> Column:
    terms = list(lex.LEGALESE)
    # By line, then by term.
    return _phrases("legalese", terms, lambda p, line, i: finding(line, _text('banned term "', squash(p), '"'), place(line, _number(terms, squash(p)) * 16777216 + i)), by_line=True)


def complex_word() -> Column:
    return _phrases("complex-word", list(lex.COMPLEX_WORDS), lambda p, line, i: finding(line, _text('"', p, '" where "', _lookup(lex.COMPLEX_WORDS, F.lower(p)), '" would do'), place(line, i)), by_line=True, pattern=COMPLEX)


def _phrase_order(b_line: Column, values: list[str], phrase: Column, i: Column) -> Column:
    """By block, then by phrase in the order of the list, then by place. Lines grow from block to block, and within a
    block the phrase's number decides before the place."""
    return F.shiftleft(b_line.cast("bigint"), 32) + _number(values, phrase) * 16777216 + i


def _in_phrase_order(rule: str, phrases: list[str], detail: Callable[[Column], Column]) -> Column:
    pattern = phrase_pattern(phrases)
    build = lambda p, line, k, i: finding(line + k, detail(p), _phrase_order(line, phrases, squash(p), i))

    def of_block(b: Column) -> Column:
        text = b.getField("text")
        return optional(text.rlike(pattern), _places(without_named(text, phrases), pattern, lambda p, k, i: build(p, b.getField("line"), k, i)))

    return _either(of_block, _told(rule, build))


def double_negative() -> Column:
    return _in_phrase_order("double-negative", list(lex.DOUBLE_NEGATIVES), lambda p: _text('"', p, '" makes the reader unpick two negatives'))


def wordy_phrase() -> Column:
    """The shipped phrases can't overlap (none begins with the end of another), so one alternation finds them all."""
    ordered = sorted(lex.WORDY, key=lambda p: -len(p.split(" ")))
    return _in_phrase_order("wordy-phrase", ordered, lambda p: _text('"', squash(p), '" says what "', _lookup(lex.WORDY, squash(p)), '" says'))


def in_title_case(phrase: str) -> str:
    return f"[{WS}]+".join(w if w in ("and", "or", "of", "the", "to") else w.capitalize() for w in phrase.split(" "))


def doublet() -> Column:
    """A phrase in title case right behind words like `called` or `the report` is a name and stays."""
    named = rf"(?i:{BEFORE}(?:called|named|titled|(?:a|an|the)[{WS}]+(?:{'|'.join(lex.NAMED_WORK)})))[{WS}]*+"
    title = "|".join(map(in_title_case, lex.DOUBLETS))
    pattern = phrase_pattern(lex.DOUBLETS)
    legal = [k for k, v in lex.DOUBLETS.items() if v is None]

    def detail(p: Column) -> Column:
        lean = _lookup({k: v for k, v in lex.DOUBLETS.items() if v}, p)
        return F.when(p.isin(legal), _text('legal-register phrase "', p, '"; review for audience fit')).otherwise(_text('redundant phrase "', p, '"; consider "', lean, '"'))

    build = lambda p, line, k, i: finding(line + k, detail(squash(p)), place(line, i))

    def of_block(b: Column) -> Column:
        # A mark in a name keeps the alternation from seeing it; line ends stay.
        text = F.regexp_replace(b.getField("text"), rf"({named})(?={BEFORE}(?:{title}){AFTER})", "$1\x03x")
        return optional(b.getField("text").rlike(pattern), _places(without_named(text, lex.DOUBLETS), pattern, lambda p, k, i: build(p, b.getField("line"), k, i)))

    return _either(of_block, _told("doublet", build))


def prose_enumeration() -> Column:
    ordinals = F.create_map(*(F.lit(x) for kv in lex.ORDINALS.items() for x in kv))

    def ranks(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(rf"(?i){BEFORE}(first|second|third|fourth|fifth|sixth)(?:ly)?{AFTER}(?!-)"), F.lit(1))
        marks = F.regexp_extract_all(text, F.lit(rf"(?<![^{WS}])(\([1-6]\)|[1-6][.)])(?![^{WS}])"), F.lit(1))
        return F.array_sort(F.array_distinct(F.concat(F.transform(words, lambda w: F.element_at(ordinals, F.lower(w))), F.transform(marks, lambda m: F.regexp_extract(m, "[1-6]", 0).cast("int")))))

    # Without a first item there is no enumeration.
    maybe = F.filter("blocks", lambda b: b.getField("text").rlike(r"[fF][iI][rR][sS][tT]|1[.)]") & b.getField("text").rlike(r"(?i)first|(?<!\S)\(?1[.)]"))
    found = F.transform(maybe, lambda b: F.struct(b.getField("line").alias("line"), ranks(F.replace(b.getField("text"), F.lit("\n"), F.lit(" "))).alias("r")))
    long = F.filter(found, lambda x: F.array_contains(x.getField("r"), 1) & (F.size(x.getField("r")) >= LIMITS["enumerationMinimumRanks"]))
    return F.transform(long, lambda x: finding(x.getField("line"), _text("enumeration ranks ", F.array_join(x.getField("r"), ", "), " in prose; consider a list")))


def filler_opening() -> Column:
    """The first line of the first block."""
    stop = r"[.,;:!?)\]" + WS + "]"

    def judge(b: Column) -> Column:
        opening = F.substring_index(b.getField("text"), "\n", 1)
        clean = F.lower(trim_ws(F.regexp_replace(F.regexp_replace(opening, "[*_`\x04]", ""), "[‘’]", "'")))

        def pick(text: Column) -> Column:
            chosen = F.lit(None).cast("string")
            for filler in reversed(lex.FILLERS):
                chosen = F.when(text.rlike(rf"^{filler}(?=$|{stop})") & ~text.rlike(rf"^{filler}[.,;:!?{WS}]*+not{AFTER}"), F.lit(filler)).otherwise(chosen)
            return let(chosen, lambda f: optional(f.isNotNull(), F.array(finding(b.getField("line"), _text('opens with "', f, '" instead of the answer')))))

        first = "|".join(sorted({f[:3] for f in lex.FILLERS}))
        return let(clean, lambda text: optional(text.rlike(f"^(?:{first})"), pick(text)))

    return optional(F.size("blocks") > 0, judge(F.get("blocks", F.lit(0))))


def heading_depth() -> Column:
    limit = LIMITS["maximumHeadingLevel"]
    deep = F.filter("headings", lambda h: h.getField("level") > limit)
    return F.transform(deep, lambda h: finding(h.getField("line"), _text("heading level ", h.getField("level"), f" (limit {limit})")))


def heading_skip() -> Column:
    level = lambda i: F.get("headings", i).getField("level")
    pairs = F.transform("headings", lambda h, i: F.struct(h.getField("line").alias("line"), h.getField("level").alias("level"), level(i - 1).alias("before")))
    jumps = F.filter(pairs, lambda x: x.getField("level") > x.getField("before") + 1)
    return F.transform(jumps, lambda x: finding(x.getField("line"), _text("heading jumps from level ", x.getField("before"), " to level ", x.getField("level"))))


def heading_style() -> Column:
    limit = LIMITS["headingWordLimit"]

    def judge(h: Column) -> Column:
        text = F.regexp_replace(h.getField("text"), rf"^(?:\d++\.)++[{WS}]++", "")
        # An escape reads as the character behind it.
        read = F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")
        form = F.regexp_replace(text, r"(?<![\\*_~])[*_~]++$", "")
        # Without a stop there is one sentence.
        n, s = words_in(text), F.when(trim_ws(text) == "", 0).when(read.rlike("[.!?]"), n_fewest(marked(read))).otherwise(1)
        detail = (
            F.when(n > limit, _text(n, f" words (limit {limit})"))
            .when(s >= 2, _text(s, " sentences in heading"))
            .when(form.endswith(".") & ~form.endswith("..."), F.lit("heading ends with a full stop"))
        )
        return let(detail, lambda d: optional(d.isNotNull(), F.array(finding(h.getField("line"), d))))

    # Only long headings (a word has a letter and a blank) and those with stops are looked at closely.
    stops = lambda t: t.contains(".") | t.contains("!") | t.contains("?")
    return each(F.filter("headings", lambda h: (F.length(h.getField("text")) > 2 * limit) | stops(h.getField("text"))), judge)


def table_header() -> Column:
    def judge(r: Column, i: Column) -> Column:
        row, below = trim_ws(r.getField("text")), F.get("rows", i + 1)
        divider = trim_ws(below.getField("text"))
        follows = r.getField("text").contains("|") & (below.getField("line") == r.getField("line") + 1)
        inner = F.when(row.startswith("|"), F.regexp_replace(row, r"^\||\|$", "")).otherwise(row)
        empty = F.exists(F.split(inner, r"\|"), lambda c: trim_ws(F.regexp_replace(c, "[*_~`]", "")) == "")
        here = F.when(follows, divider.rlike(rf"^\|?[{WS}:|-]++$") & divider.contains("-") & empty)
        return optional(here, F.array(finding(r.getField("line"), F.lit("table header has an empty column name"))))

    return F.flatten(F.transform("rows", judge))


# Links and images. `links` has those of Markdown, `markup` the lines with their tags.

#: An element's attributes, within which a quoted `>` ends nothing.
IN_TAG = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+"
NBSP = "(?i)&nbsp;|&#0*160;|&#x0*a0;"


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, without its quotes; null where it is missing, empty where it is empty."""
    pattern = rf"(?i)(?:^|[^A-Za-z0-9_]){name}\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]++)"
    value = F.regexp_replace(F.regexp_extract(attrs, pattern, 1), "(?s)^([\"'])(.*)\\1$", "$2")
    return F.when(attrs.rlike(pattern), value)


def spoken(label: Column) -> Column:
    """What is read out: no tags, no emphasis, single spaces."""
    return trim_ws(F.regexp_replace(F.regexp_replace(F.regexp_replace(label, rf"<{IN_TAG}>|{NBSP}", " "), "[*_~`]++", ""), f"[{WS}]++", " "))


def _vague(line: Column, ord_: Column, label: Column, target: Column, unless: Column | None = None) -> Column:
    def judge(text: Column) -> Column:
        vague = F.lower(text).isin(list(lex.VAGUE_LINKS)) | text.rlike(r"(?i)^<?(?:https?://|www\.)")
        detail = F.when(text == "", F.lit("link has no text; say where it goes") if unless is None else F.when(~unless, F.lit("link has no text; say where it goes")))
        detail = detail.when(vague, _text('link text "', text, '" describes no destination (', F.substring(target, 1, 40), ")"))
        return let(detail, lambda d: optional(d.isNotNull(), F.array(finding(line, d, ord_))))

    return let(spoken(label), judge)


def elements(close: str, inner: str, judge: Callable[[Column, Column, Column], Column]) -> Column:
    """judge(element, line, number) for the elements of markup that end with the pattern `close`; `inner` finds the
    element in the text up to there. The text is cut behind each end, and the marks of a line tell on which line an
    element ends; its own line ends lead back to where it begins."""

    def cut(m: Column) -> Column:
        ended = F.flatten(F.transform(F.split(m, "\n"), lambda l, k: F.array_repeat(k + 1, occurrences(l, "\x01"))))  # noqa: E741
        # One that a blank line cuts is none, so only what is behind the last of these counts.
        whole = F.transform(F.split(m, "\x01"), lambda p: F.regexp_extract(F.regexp_replace(p, r"(?s)^.*\n[ \t]*+\n", ""), inner, 0))
        both = F.zip_with(ended, F.slice(whole, 1, F.size(ended)), lambda k, w: F.struct((k - newlines(w)).alias("k"), w.alias("w")))
        return F.flatten(F.transform(both, lambda x, i: optional(x.getField("w") != "", judge(x.getField("w"), x.getField("k"), i))))

    return optional(F.col("markup").rlike(close), let(F.regexp_replace("markup", close, "$0\x01"), cut))


def link_text() -> Column:
    def markdown(x: Column) -> Column:
        target = trim_ws(x.getField("target"))
        return optional(~x.getField("image"), _vague(x.getField("line"), place(x.getField("line"), F.least(x.getField("at"), F.lit(0x7FFFFFFF))), x.getField("label"), target, x.getField("kind") == "shortcut"))

    def anchor(whole: Column, line: Column, i: Column) -> Column:
        href = attribute(F.regexp_extract(whole, rf"(?i)^<a\b({IN_TAG})>", 1), "href")
        body = F.regexp_replace(whole, rf"(?i)^<a\b{IN_TAG}>|</a\s*+>$", "")
        return let(href, lambda target: optional(target.isNotNull(), _vague(line, F.lit(1 << 62) + i, body, target)))

    return joined(each("links", markdown), elements(r"(?i)</a\s*+>", rf"(?i)<a\b{IN_TAG}>[\s\S]*+$", anchor))


def image_alt() -> Column:
    def markdown(x: Column) -> Column:
        silent = x.getField("image") & (x.getField("kind") != "shortcut") & (trim_ws(x.getField("label")) == "")
        meant = (x.getField("kind") == "inline") & x.getField("target").rlike(r"(?i)\s(?:\"decorative\"|'decorative'|\(decorative\))\s*+$")
        return optional(silent & ~meant, F.array(finding(x.getField("line"), _text("image has no alternative text (", F.substring(x.getField("target"), 1, 40), ")"), place(x.getField("line"), F.least(x.getField("at"), F.lit(0x7FFFFFFF))))))

    def image(whole: Column, line: Column, i: Column) -> Column:
        attrs = F.regexp_extract(whole, rf"(?i)^<img\b({IN_TAG})>$", 1)
        return optional(attribute(attrs, "alt").isNull(), F.array(finding(line, _text("image has no alternative text (", F.substring(F.coalesce(attribute(attrs, "src"), F.lit("image")), 1, 40), ")"), F.lit(1 << 62) + i)))

    tag = rf"(?i)<img\b{IN_TAG}>"
    return joined(each("links", markdown), elements(tag, tag + "$", image))


#: Rule -> its findings in a document, but for the acronym rule, which looks at words in order.
OPERATORS: dict[str, Callable[[], Column]] = {
    "sentence-length": sentence_length,
    "paragraph-length": paragraph_length,
    "legalese": legalese,
    "sentence-average": sentence_average,
    "heading-depth": heading_depth,
    "heading-skip": heading_skip,
    "heading-style": heading_style,
    "doublet": doublet,
    "prose-enumeration": prose_enumeration,
    "wordy-phrase": wordy_phrase,
    "complex-word": complex_word,
    "double-negative": double_negative,
    "filler-opening": filler_opening,
    "table-header": table_header,
    "link-text": link_text,
    "image-alt": image_alt,
}
#: Rules that need marked texts, and those that need the blocks with phrases.
ON_SENTENCES = {"sentence-length", "paragraph-length", "sentence-average"}
ON_PHRASES = {"legalese", "complex-word", "double-negative", "wordy-phrase", "doublet"}
