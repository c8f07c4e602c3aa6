"""Column functions on text: white space, words, lines, phrases, the hash of the thresholds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.lexicon import THRESHOLDS

#: White space as the rules know it, wider than Java's \s.
ALL_WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Blocks are made with `plainer`, after which only these are left. Java looks them up in one table.
WS = r"\t\n\x0B\f\r "
WS_CHARS = "\t\n\x0b\f\r "
#: The same without line ends.
WS_INLINE = r"\t\x0B\f\r "
RARE_WS = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CLOSERS = "*_`\"'’”)\\]}"
#: ASCII word boundaries on either side.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences(c: Column, mark: str) -> Column:
    """How often a single character stands in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def plainer(c: Column) -> Column:
    """Blanks for white space beyond ASCII. Texts of ASCII alone, which have as many bytes as characters, have none."""
    return F.when((F.octet_length(c) != F.length(c)) & c.rlike(RARE_WS), F.regexp_replace(c, RARE_WS, " ")).otherwise(c)


def words_in(c: Column) -> Column:
    """The number of words: each becomes one mark."""
    return occurrences(F.regexp_replace(c, f"[^{WS}]++", "\x06"), "\x06")


def newlines(c: Column) -> Column:
    return occurrences(c, "\n")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def phrase_pattern(phrases: Iterable[str]) -> str:
    """One alternation of phrases as whole words, more words first; any white space may stand between words. Phrases
    are grouped by their first letter, so that most places are ruled out by one look."""
    by: dict[str, list[str]] = {}
    for p in sorted(phrases, key=lambda p: -len(p.split(" "))):
        by.setdefault(p[0], []).append(rf"[{WS}]+".join(p.split(" "))[1:])
    return "(?i)" + BEFORE + "(" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")" + AFTER


def first_look(phrases: Iterable[str]) -> str:
    """A pattern without boundaries or looks around that all texts with one of the phrases match, and few others."""
    return "(?i)" + "|".join(rf"[{WS}]+".join(p.split(" ")) for p in sorted(phrases))


#: Spans in quotes or backticks, paired from the left.
SPANS = "`[^`]*+`|[“”\"][^“”\"]*+[“”\"]|'[^']*+'|‘[^’]*+’"


def without_named(c: Column, phrases: Iterable[str]) -> Column:
    """Drops the spans that hold one of the phrases alone: these name a term and do not use it. All other spans are
    matched too and stay, so that quotes pair from the left."""
    inner = f"[{WS_INLINE}]*+(?:{'|'.join(phrases)})[{WS_INLINE}]*+"
    named = f"`{inner}`|[“”\"]{inner}[“”\"]|'{inner}'|‘{inner}’"
    return F.when(c.rlike("[`“”\"'‘]"), F.regexp_replace(c, f"(?i){named}|({SPANS})", "$1")).otherwise(c)


def barrier(df: DataFrame) -> DataFrame:
    """The same rows, across a one-row generator that no filter is pushed through. Filters pushed into projections of
    higher-order functions would work their arrays out again for each element."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("x")).select("x.*")


def table_cell(c: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, on which the character at an offset from 0 stands."""
    return occurrences(F.substring(text, F.lit(1), offset), "\n") + 1


def squash(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.regexp_replace(c, f"[{WS}]+", " "))


def to_fixed_1(total_words: Column, count: Column) -> Column:
    """The mean to one decimal, exact halves upwards, as text. The double's exact value decides, as decimals of
    enough digits hold it."""
    exact = (total_words.cast("double") / count.cast("double")).cast("decimal(38,20)")
    return F.round(exact, 1).cast("decimal(20,1)").cast("string")


def config_hash(thresholds: dict[str, int] | None = None) -> str:
    """Eight hex digits that identify a set of thresholds."""
    h = 5381
    for c in "|".join(f"{k}={v}" for k, v in sorted((thresholds or THRESHOLDS).items())):
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    return f"{h:08x}"
