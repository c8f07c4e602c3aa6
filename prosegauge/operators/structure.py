"""Documents as one row each, with arrays of what the rules read.

A corpus is (doc, text). `parsed` gives each document's blocks, headings, rows, links and markup. Plain documents,
which hold nothing that could be Markdown structure, are cut at blank lines by Spark's own expressions; all others go
through the small reader in `prosegauge.operators.markdown`, a batch at a time. Both happen in one projection, so a
corpus is scanned once, without a shuffle, whatever its documents hold.

Null texts count as empty: no blocks. White space beyond ASCII is read as blanks, once lines are told apart. The control characters U+0001 to U+0004, which mark places below, are read as
U+FFFD. Line ends of all kinds are equal, and a leading byte order mark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from prosegauge.functions import lexicon as lex
from prosegauge.functions.text import RARE_WS, barrier, let, plainer, trim_ws
from prosegauge.operators.markdown import structure
from prosegauge.operators.rules import SAID
from prosegauge.operators.said import PHRASES, said

#: Anything that may be structure, or change what a reader sees of a line.
SPECIAL = r"[<\[\\`]|(?:^|[\n\x{85}\x{2028}\x{2029}])(?: {4}|\t| {0,3}(?:#|>|~~~|[-*+=_]|\d{1,9}[.)])|[ \t]*+[|:]?[ \t]*+:?-)"
#: What texts of one block match unless their white space is tidy: lone blanks and line ends, none at either edge.
UNTIDY = r"^$|^[ \n]|[ \n]$|  |\n[ \n]|[\t\x0B\f\x{85}]|" + RARE_WS
#: What texts match in which there may be acronyms, and enumerations.
CAPITALS, RANKS = r"[A-Z]{2}|[A-Z]\.[A-Z]\.", r"(?i)first|1[.)]"
#: What the first blocks of texts match that may open with a filler: marks that don't show may stand between letters, and
#: what is not ASCII may become a letter in lower case.
_LETTER = lambda c: f"(?:[{c}{c.upper()}]|[^\\x00-\\x7f])[*_`\x04]*"
OPENERS = r"^[*_`\x04\t\n\x0B\f\r ]*(?:" + "|".join("".join(map(_LETTER, start)) for start in sorted({f[:3] for f in lex.FILLERS})) + ")"
BLOCK = "array<struct<line:int,text:string>>"
HEADING = "array<struct<line:int,level:int,text:string>>"
LINK = "array<struct<line:int,at:bigint,image:boolean,kind:string,label:string,target:string>>"

_text, _int = pa.string(), pa.int32()
_block = pa.list_(pa.struct([("line", _int), ("text", _text)]))
_heading = pa.list_(pa.struct([("line", _int), ("level", _int), ("text", _text)]))
_link = pa.list_(pa.struct([("line", _int), ("at", pa.int64()), ("image", pa.bool_()), ("kind", _text), ("label", _text), ("target", _text)]))
_read = pa.struct([("blocks", _block), ("headings", _heading), ("rows", _block), ("links", _link), ("markup", _text)])
_sentences = pa.list_(pa.struct([("n", _int), ("at", _int)]))
_doubts = pa.list_(pa.struct([("i", _int), ("before", _text), ("after", _text)]))
_parts = pa.list_(pa.struct([("line", _int), ("sentences", _sentences), ("doubts", _doubts)]))
_said = pa.list_(pa.struct([("line", _int), ("kind", _int), ("k", _int), ("i", _int), ("phrase", _text)]))
_looks = [("phrases", pa.bool_()), ("searched", pa.bool_()), *((x, pa.bool_()) for x in ("acronyms", "ranks", "openers", "tables", "lengthy")), ("sentences", _sentences), ("doubts", _doubts), ("parts", _parts), ("said", _said)]
_structure = pa.struct([*_read, *(pa.field(*x) for x in _looks)])


#: Characters of text whose structure a worker holds at a time; it takes some fifteen times their size as objects.
AT_A_TIME = 1 << 20


#: Texts of more bytes are not measured by numpy, which takes some ten times their size.
LARGE = 16 << 20
_STOP, _CLOSER = (np.isin(np.arange(256), [ord(c) for c in marks]) for marks in (".!?", "*_`\"')]}"))
#: Titles, abbreviations and letters as numbers, a byte a letter from the last.
_SHORT = [int.from_bytes(w[::-1].encode(), "big") for w in (*lex.TITLES, *lex.ABBREVIATIONS, *"abcdefghijklmnopqrstuvwxyz")]


def sentences_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The words of each sentence and the line ends before it, for tidy texts (`UNTIDY`): a sentence ends with each word
    that ends in a stop and marks that close. Words of all texts are looked at together. Where that may be no end, the
    words on both sides are told too."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    ends_of = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends_of[0] : ends_of[-1]]
    edges = ends_of - ends_of[0]
    letter = (data != 32) & (data != 10)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    first[edges[:-1]] = last[edges[1:] - 1] = True
    starts, at = np.flatnonzero(first), np.flatnonzero(last)
    behind = at + 1
    # From the last letter of each word back over marks that close; two of them have three bytes, E2 80 and one of two.
    live = np.arange(len(at))
    while len(live):
        k = at[live]
        width = _CLOSER[data[k]].astype(np.int64)
        width[(k - 2 >= starts[live]) & ((data[k] == 0x99) | (data[k] == 0x9D)) & (data[k - 1] == 0x80) & (data[k - 2] == 0xE2)] = 3
        at[live] -= width
        live = live[(width > 0) & (at[live] >= starts[live])]
    ends = (at >= starts) & _STOP[data[at]]
    words = np.searchsorted(starts, edges)
    ends[words[1:] - 1] = True
    final = np.flatnonzero(ends)
    begun = np.concatenate([[0], final[:-1] + 1])
    counts = np.searchsorted(final, words)
    lines = np.flatnonzero(data == 10)
    before = np.searchsorted(lines, starts[begun]) - np.repeat(np.searchsorted(lines, edges[:-1]), np.diff(counts))
    item = pa.StructArray.from_arrays([pa.array(final - begun + 1, _int), pa.array(before, _int)], ["n", "at"])
    # A stop may end no sentence behind one of these words, a single letter or letters with dots; Spark judges.
    maybe = np.flatnonzero((data[at[final]] == 46) & ~np.isin(final, words[1:] - 1))
    k, floor, code, on = at[final[maybe]], starts[final[maybe]], np.zeros(len(maybe), np.int64), True
    while (dot := (k >= floor) & (data[k] == 46)).any():
        k -= dot
    for _ in range(7):
        letters = data[k] | 32
        on &= (k >= floor) & (letters >= 97) & (letters <= 122)
        code = np.where(on, code << 8 | letters, code)
        k -= on
    maybe = maybe[np.isin(code, _SHORT) | ((k >= floor) & (data[k] == 46))]
    word = lambda w: [data[x:y].tobytes().decode() for x, y in zip(starts[w], behind[w])]
    place = maybe + 1 - np.repeat(counts[:-1], np.diff(np.searchsorted(maybe, counts)))
    told = pa.StructArray.from_arrays([pa.array(place, _int), pa.array(word(final[maybe]), _text), pa.array(word(final[maybe] + 1), _text)], ["i", "before", "after"])
    return pa.ListArray.from_arrays(pa.array(counts, _int), item), pa.ListArray.from_arrays(pa.array(np.searchsorted(maybe, counts), _int), told)


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _tidy(texts: pa.Array) -> np.ndarray:
    small = pc.fill_null(pc.less_equal(pc.binary_length(texts), LARGE), False).to_numpy(zero_copy_only=False)
    return small & ~_found(texts, UNTIDY)


def lengthy(sentences: pa.Array, doubts: pa.Array, owner: np.ndarray, n: int) -> np.ndarray:
    """Of n texts those whose sentences may be too long or too many in a block, or too long on average."""
    words = sentences.flatten().field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(size) - size
    limits = lex.THRESHOLDS
    block = (np.maximum.reduceat(words, begins) > limits["sentenceWordLimit"]) | (size > limits["paragraphSentenceLimit"]) | (pc.list_value_length(doubts).to_numpy(zero_copy_only=False) > 0)
    every, total = np.bincount(owner, size, n), np.bincount(owner, np.add.reduceat(words, begins), n)
    average = (every >= limits["averageMinimumSentences"]) & (total > limits["sentenceAverageLimit"] * every)
    return average | (np.bincount(owner[block], minlength=n) > 0)


def looks(texts: pa.Array, special: np.ndarray, read: pa.Array) -> list[pa.Array]:
    """What patterns that go through a text once tell: whether phrases, acronyms and enumerations may stand in it, the
    phrases and the sentences of its blocks. Blocks are those read from texts with structure, and tidy plain texts; of
    other plain texts Spark cuts and searches the blocks."""
    n = len(texts)
    known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~special & known)
    of_plain = texts.take(pa.array(plain))
    clear = _tidy(of_plain)
    blocks = read.flatten()[0]
    inner, of_inner = blocks.flatten(), pc.list_parent_indices(blocks).to_numpy(zero_copy_only=False)
    inner_line, inner_text = inner.field("line"), inner.field("text")
    marks = {}
    for name, pattern in (("acronyms", CAPITALS), ("ranks", RANKS)):
        marks[name] = np.zeros(n, bool)
        marks[name][plain] = _found(of_plain, pattern)
        marks[name][of_inner[_found(inner_text, pattern)]] = True
    marks["tables"] = special & _found(texts, r"\|")
    # Phrases.
    own = plain[clear]
    owner = np.concatenate([own, of_inner])
    line = np.concatenate([np.ones(len(own), np.int64), inner_line.to_numpy(zero_copy_only=False)])
    clear_text = of_plain.filter(pa.array(clear))
    may, left, found = said(pa.concat_arrays([clear_text, inner_text]))
    marks["phrases"], marks["searched"] = np.zeros(n, bool), np.zeros(n, bool)
    rough = plain[~clear]
    marks["searched"][rough] = _found(pc.replace_substring_regex(texts.take(pa.array(rough)), RARE_WS, " "), PHRASES)
    heads, first = np.unique(of_inner, return_index=True)
    marks["openers"] = np.zeros(n, bool)
    marks["openers"][rough] = True
    marks["openers"][own] = _found(clear_text, OPENERS)
    marks["openers"][heads] = _found(inner_text.take(pa.array(first)), OPENERS)
    marks["searched"][owner[left]] = True
    marks["phrases"][owner[may]] = True
    marks["phrases"] |= marks["searched"]
    told: list[list[dict] | None] = [None] * n
    for block, x in found:
        if not marks["searched"][k := owner[block]]:
            told[k] = told[k] or []
            told[k].append({"line": line[block], **x})
    # Sentences. Of a text with structure, all blocks are measured or none.
    whole = special.copy()
    whole[of_inner[~_tidy(inner_text)]] = False
    kept = pa.array(whole[of_inner], pa.bool_())
    sentences, doubts, parts = pa.nulls(n, _sentences), pa.nulls(n, _doubts), pa.nulls(n, _parts)
    every = pa.concat_arrays([clear_text, inner_text.filter(kept)])
    marks["lengthy"] = special & ~whole
    marks["lengthy"][rough] = True
    if len(every):
        index = np.full(n, -1)
        index[own] = np.arange(len(own))
        index = pa.array(index, _int, mask=index < 0)
        measured = sentences_of(every)
        sentences, doubts = (x.take(index) for x in measured)
        marks["lengthy"] |= lengthy(*measured, np.concatenate([own, of_inner[whole[of_inner]]]), n)
        each = pa.StructArray.from_arrays([inner_line.filter(kept), *(x.slice(len(own)) for x in measured)], ["line", "sentences", "doubts"])
        ends = np.cumsum(np.where(whole, np.bincount(of_inner, minlength=n), 0))
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), _int), each, mask=pa.array(~whole))
    of = {**{k: pa.array(v) for k, v in marks.items()}, "sentences": sentences, "doubts": doubts, "parts": parts, "said": pa.array(told, _said)}
    return [of[name] for name, _ in _looks]


def in_pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The structure of a batch in pieces, as a batch has up to 10,000 texts of any length: all of its structure at
    once would take hundreds of MB. Plain texts have none, and only what Arrow's patterns tell, which go through a text
    once, in a fraction of the time that Java's take."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_A_TIME, "right")))
        part = texts.slice(at, end - at)
        at = end
        special = _found(part, SPECIAL.replace("*+", "*"))
        read = pa.array([structure(part[k].as_py()) if deep else None for k, deep in enumerate(special.tolist())], _read)
        yield pa.StructArray.from_arrays([*read.flatten(), *looks(part, special, read)], [f.name for f in _structure])


@F.arrow_udf(from_arrow_type(_structure))
def marked_structure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield from in_pieces(texts)


def normalised(text: Column) -> Column:
    """Most texts hold nothing of all this, which a search for a character tells sooner than a pattern."""
    marks = [F.lit(c) for c in "\x01\x02\x03\x04"]
    # Bytes that are no text become U+FFFD, as patterns would make of them.
    whole = F.make_valid_utf8(F.coalesce(text, F.lit("")))
    odd = whole.startswith("\ufeff") | whole.contains("\r")
    for c in marks:
        odd = odd | whole.contains(c)
    clean = F.regexp_replace(F.regexp_replace(whole, "^\ufeff", ""), "\r\n?", "\n")
    return F.when(odd, F.regexp_replace(clean, "[\x01-\x04]", "\ufffd")).otherwise(whole)


def plain_blocks(text: Column) -> Column:
    return let(plainer(text), _cut_blocks)


def _cut_blocks(text: Column) -> Column:
    """Runs of lines that are not blank, with the line each begins on. Two arrays are made side by side: texts by
    cutting at blank lines, and the places of lines that follow a blank one."""
    left = lambda c: F.regexp_replace(c, r"(?m)^[ \t]++", "")
    block = lambda line, t: F.struct(line.cast("int").alias("line"), t.alias("text"))
    blank = lambda l: F.trim(F.replace(l, F.lit("\t"), F.lit(" "))) == ""  # noqa: E731, E741

    def cut(lines: Column) -> Column:
        begins = F.filter(F.transform(lines, lambda l, i: F.when(~blank(l) & ((i == 0) | blank(F.get(lines, i - 1))), i + 1)), lambda i: i.isNotNull())  # noqa: E741
        texts = F.filter(F.split(text, r"\n(?:[ \t]*+\n)++|^(?:[ \t]*+\n)++"), lambda t: ~blank(F.replace(t, F.lit("\n"), F.lit(" "))))
        return F.zip_with(begins, texts, block)

    whole = F.array(block(F.lit(1), text))
    many = F.get(F.transform(F.array(F.split(text, "\n")), cut), F.lit(0))
    found = F.when(text.rlike(r"(?m)^[ \t]*+$"), many).otherwise(whole)
    tidy = lambda b: block(b.getField("line"), F.rtrim(left(b.getField("text")), F.lit("\n")))
    return F.filter(F.transform(found, tidy), lambda b: trim_ws(b.getField("text")) != "")


#: Inputs between these sizes in bytes are dealt over all cores first.
SPREAD_FROM, SPREAD_TO = 2 << 20, 1 << 30


def spread(corpus: DataFrame) -> DataFrame:
    """A small file is often a single row group, which one task reads however many cores wait. Below a GB, moving the
    texts once costs less than that; larger inputs have row groups enough and stay where they are."""
    if corpus.isStreaming:
        return corpus
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    # By row, as rows without an id or with the same one would meet in one task.
    return corpus.repartition(cores) if SPREAD_FROM < size < SPREAD_TO else corpus


def parsed(corpus: DataFrame) -> DataFrame:
    """(doc, blocks, headings, rows, links, markup, phrases, searched, acronyms, ranks, openers, tables, lengthy,
    sentences, doubts, parts, said), one row a document. phrases, acronyms, ranks, openers, tables: whether these may stand
    in it; lengthy: whether its sentences may be too long or too many; searched: whether phrases are still to be looked
    for; said: those that were found; sentences: those of a tidy plain text, else null, and doubts, places that may end none;
    parts: the same for each block of a text with structure, if all are tidy, else null. rows holds the lines that line rules read; a
    plain document's lines need none of these rules, so it has no rows."""
    clean = barrier(spread(corpus.select("doc", "text")).select("doc", normalised(F.col("text")).alias("text")))
    both = clean.select("doc", "text", marked_structure("text").alias("m"))
    none = lambda kind: F.array().cast(kind)
    # A text whose sentences are known is one tidy block.
    whole = F.array(F.struct(F.lit(1).alias("line"), F.col("text")))
    rows = both.select(
        "doc",
        F.when(F.col("m.sentences").isNotNull(), whole).when(F.col("m.blocks").isNull(), plain_blocks(F.col("text"))).otherwise(F.col("m.blocks")).alias("blocks"),
        F.coalesce("m.headings", none(HEADING)).alias("headings"),
        F.coalesce("m.rows", none(BLOCK)).alias("rows"),
        F.coalesce("m.links", none(LINK)).alias("links"),
        F.coalesce("m.markup", F.lit("")).alias("markup"),
        *(F.coalesce(f"m.{look}", F.lit(True)).alias(look) for look in ("phrases", "searched", "acronyms", "ranks", "openers", "tables", "lengthy")),
        "m.sentences",
        "m.doubts",
        "m.parts",
        F.coalesce("m.said", none(SAID)).alias("said"),
    )
    return barrier(rows)


class Parsed:
    """A corpus parsed once. `rows` has one row a document; blocks and headings are these rows unfolded."""

    def __init__(self, corpus: DataFrame) -> None:
        self.corpus = corpus
        self.rows = parsed(corpus)

    @property
    def blocks(self) -> DataFrame:
        """(doc, line, text) of reader-visible paragraphs."""
        return self.rows.select("doc", F.inline("blocks"))

    @property
    def headings(self) -> DataFrame:
        """(doc, line, level, text)"""
        return self.rows.select("doc", F.inline("headings"))
