"""Sentences of blocks, in two readings.

A place where white space follows a full stop, question or exclamation mark (and marks that may close after it) may end
a sentence. Whether it does depends on the last word before and the first word after alone: the verdict is `split`,
`merge` or `ambiguous`. The reading with most sentences takes doubtful places as ends, the reading with fewest does not.

`marked` writes the verdict into the text, as one control character behind the white space, so that counting sentences
is counting characters, and cutting a text into sentences is one split. Few places need more than a look at the word
before them: only titles, initials, abbreviations and dotted forms can be anything but an end. All of this is linear in
the text and stays within a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions.lexicon import ABBREVIATIONS, LOWERCASE_NAMES, STARTERS, TITLES
from prosegauge.functions.text import CLOSERS, WS, WS_CHARS, let, occurrences, trim_ws, words_in

SPLIT, AMBIGUOUS, MERGE = "\x01", "\x02", "\x03"
END = f"([.!?][{CLOSERS}]*+[{WS}]++)"
#: What `measured` makes of the blocks of a text.
MARKS = "array<struct<line:int,sentences:array<struct<n:int,at:int>>,few:int>>"
#: A word that may be a title, an initial, an abbreviation or a dotted form; all others end a sentence.
DOUBTFUL = rf"(?i)(?<![a-z])(?:{'|'.join(r'\.*+'.join(w) for w in (*TITLES, *ABBREVIATIONS))}|[a-z]|[a-z](?:\.[a-z])++)\.++[{CLOSERS}]*+\z"


def last_word(fragment: Column) -> Column:
    """A fragment's last word without closing marks, read from the end, as a search would try each place before it."""
    return F.reverse(F.regexp_extract(F.reverse(fragment), f"^[{WS}]*+[{CLOSERS}]*+([^{WS}]*+)", 1))


def first_word(fragment: Column) -> Column:
    return F.regexp_extract(fragment, f"^[{WS}]*+([^{WS}]*+)", 1)


def verdict(token: Column, nxt: Column) -> Column:
    """The mark for the place between a fragment that ends in token and one that begins with nxt (fixed table)."""
    word = F.lower(F.regexp_replace(F.replace(token, F.lit("."), F.lit("")), "^[^A-Za-z]+", ""))
    capital = nxt.rlike("^[^A-Za-z]*[A-Z]")
    starter = capital & F.lower(F.regexp_replace(nxt, "[^A-Za-z]", "")).isin(STARTERS)
    name = F.regexp_replace(nxt, "[^A-Za-z0-9]", "").isin(LOWERCASE_NAMES)
    lower = nxt.rlike("^[^A-Za-z]*[a-z]") & ~name
    return (
        F.when(~token.endswith("."), SPLIT)
        .when(word.isin(TITLES), MERGE)
        .when(token.rlike(r"^[^A-Za-z]*[A-Z]\.$"), F.when(capital & ~starter, MERGE).otherwise(AMBIGUOUS))
        .when(
            word.isin(ABBREVIATIONS),
            F.when(nxt.rlike("^[^A-Za-z0-9]*[A-Z0-9][^A-Za-z]*$"), MERGE).when(starter, SPLIT).when(name | capital, AMBIGUOUS).otherwise(MERGE),
        )
        .when(token.rlike(r"^[^A-Za-z]*(?:[A-Za-z]\.){2,}+$"), F.when(lower, MERGE).when(starter, SPLIT).otherwise(AMBIGUOUS))
        .otherwise(SPLIT)
    )


def marked(text: Column) -> Column:
    """The text, without white space around it, with a mark before each fragment but the first."""

    def judge(parts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            # What follows the last blank holds the last word.
            end = F.substring_index(F.rtrim(before, F.lit(WS_CHARS)), " ", -1)
            return F.when(i == 0, x).when(end.rlike(DOUBTFUL), F.concat(verdict(last_word(before), first_word(x)), x)).otherwise(F.concat(F.lit(SPLIT), x))

        return F.array_join(F.transform(parts, one), "")

    return let(F.split(F.regexp_replace(trim_ws(text), END, f"$1{SPLIT}"), SPLIT), judge)


def measured(b: Column) -> Column:
    """What the rules read of a block's sentences: struct<line, sentences, few>. sentences has the words of each in the
    reading with most and the line ends before it, few is their number in the reading with fewest."""
    each = lambda m: F.zip_with(sentence_words(m), sentence_lines(m), lambda n, at: F.struct(n.alias("n"), at.alias("at")))
    return let(marked(b.getField("text")), lambda m: F.struct(b.getField("line").alias("line"), each(m).alias("sentences"), n_fewest(m).alias("few")))


def settled(sentences: Column, doubts: Column, line: Column | None = None) -> Column:
    """The same for a block, by default a text's only one, cut behind every stop, whose doubtful places are known: struct<i, before,
    after> of the sentence from 0 that begins behind such a place and the words on both sides."""
    place = lambda d: F.when(d.getField("before").rlike(DOUBTFUL), verdict(last_word(d.getField("before")), d.getField("after"))).otherwise(SPLIT)
    judged = F.transform(doubts, lambda d: F.struct(d.getField("i").alias("i"), place(d).alias("v")))
    block = lambda found, few: F.struct((F.lit(1) if line is None else line).alias("line"), found.alias("sentences"), few.alias("few"))

    def joined(begins: Column) -> Column:
        def one(b: Column, k: Column) -> Column:
            parts = F.slice(sentences, b + 1, F.coalesce(F.get(begins, k + 1), F.size(sentences)) - b)
            return F.struct(F.aggregate(parts, F.lit(0), lambda a, x: a + x.getField("n")).alias("n"), F.get(sentences, b).getField("at").alias("at"))

        return F.transform(begins, one)

    def judge(ds: Column) -> Column:
        merged = F.transform(F.filter(ds, lambda d: d.getField("v") == MERGE), lambda d: d.getField("i"))
        few = F.size(sentences) - F.size(F.filter(ds, lambda d: d.getField("v") != SPLIT))
        whole = let(F.array_except(F.sequence(F.lit(0), F.size(sentences) - 1), merged), joined)
        return block(F.when(F.size(merged) > 0, whole).otherwise(sentences), few)

    return F.when(F.size(doubts) == 0, block(sentences, F.size(sentences))).otherwise(let(judged, judge))


def n_most(m: Column) -> Column:
    """Sentences in the reading with most; m is a marked text that holds a word."""
    return occurrences(m, SPLIT) + occurrences(m, AMBIGUOUS) + 1


def n_fewest(m: Column) -> Column:
    return occurrences(m, SPLIT) + 1


def sentence_words(m: Column) -> Column:
    """The numbers of words of the sentences, in the reading with most. Where single blanks part all words, these are
    counted: one behind each word but the last, and marks stand behind blanks."""
    parts = lambda t: F.split(F.replace(t, F.lit(AMBIGUOUS), F.lit(SPLIT)), SPLIT)

    def counted(t: Column) -> Column:
        odd = F.lit(False)
        for gap in ("  ", *(c for c in WS_CHARS if c not in " \n")):
            odd = odd | t.contains(gap)
        blanks = let(parts(t), lambda p: F.transform(p, lambda x, i: occurrences(x, " ") + F.when(i == F.size(p) - 1, 1).otherwise(0)))
        return F.when(odd | (t == "") | t.startswith(" ") | t.endswith(" "), F.transform(parts(t), words_in)).otherwise(blanks)

    return let(F.replace(m, F.lit("\n"), F.lit(" ")), counted)


def sentence_lines(m: Column) -> Column:
    """For each sentence of that reading, the line ends before it. A mark stands on the line of the sentence behind
    it, so the marks of a line give its number as often as there are sentences that begin on it."""
    begun = F.transform(F.split(m, "\n"), lambda l, k: F.array_repeat(k, occurrences(l, SPLIT) + occurrences(l, AMBIGUOUS)))  # noqa: E741
    return F.concat(F.array(F.lit(0)), F.flatten(begun))
