"""Acronyms that a document uses before it says what they stand for.

The rule is one column over a parsed document, as all others are. A block's words become an array of small structs, and
only blocks with capitals in a row are cut up. Looks back and ahead are places in that array; runs of capitals are runs
of one letter in a *class string*, which has a character for each word; expansions are read from a second array, of the
words that have an initial or close a bracket, as many of them as the acronym has letters. Uses and definitions of the
document then meet in one sorted array, in which the first entry of an acronym tells all. So nothing is shuffled, no
window is opened, and a document is scanned with its other rules.

Work is linear in a block but for one odd mixture: many dotted acronyms of the letter A alone (whose letters count as
small words and so as no initials) between many brackets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.functions.everyday import everyday
from prosegauge.functions.text import WS, barrier, let
from prosegauge.operators.structure import parsed

#: The shapes of an acronym, and of one that a bracket holds behind its meaning.
SHAPE = r"^(?:[A-Z]{2,6}|[A-Z]\.(?:[A-Z]\.)+)$"
DEFINED = r"\(([A-Z][A-Z.]{1,5})\)"
#: Blocks without this can't have an acronym and are not cut into words.
CANDIDATE = r"[A-Z]{2}|[A-Z]\.[A-Z]\."
#: A word that `token_of` reads as an acronym.
SPELT = rf"(?<![^{WS}])[\"'“‘(\[{{<]*+([A-Z]{{2,6}}|(?:[A-Z]\.){{2,}})\.?[\"'”’)\]}}>,:;!?]*+(?![^{WS}])"
#: Such a word with a bracket that opens one of the next three.
EXPLAINED = rf"{SPELT}[{WS}]++(?:[^{WS}]++[{WS}]++){{0,2}}\("
#: Words that are looked at closely; how many words before and after one of them the rule reads, brackets apart.
HOT, BACK, AHEAD = r"[A-Z]{2}|[A-Z]\.[A-Z]", 5, 1
#: What an entry of a document is; at one place a definition comes first.
SAID, USED = 0, 1
#: Tables of everyday words up to this size become part of the plan; larger ones are joined.
LISTED = 50_000
#: Between the words of a list, and between its parts.
MARK, PART = "|", ";"

Test = Callable[[Column], Column]


def initials(text: Column) -> Column:
    """Upper-case first letters of a text's words, small words left out."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: ~F.lower(x).isin(lex.EXPANSION_STOP_WORDS))
    return F.upper(F.array_join(F.transform(words, lambda x: F.substring(x, 1, 1)), ""))


def word_initials(raw: Column) -> Column:
    """The same for a word between blanks, most of which are one run of letters."""
    bare = F.regexp_replace(raw, "[^A-Za-z]++", "")
    one = F.when(F.lower(bare).isin(lex.EXPANSION_STOP_WORDS), "").otherwise(F.upper(F.substring(bare, 1, 1)))
    return F.when(raw.rlike("^[^A-Za-z]*+[A-Za-z]*+[^A-Za-z]*+$"), one).otherwise(initials(raw))


def _event(key: Column, line: Column, at: Column, kind: Column, token: Column) -> Column:
    place = F.shiftleft(line.cast("bigint"), 32) + at
    return F.struct(key.alias("key"), place.alias("pos"), kind.alias("kind"), line.alias("line"), token.alias("token"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, f"[{WS}]+"), lambda w: w != "")


def bare(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^A-Za-z]++", "")


def token_of(raw: Column) -> Column:
    """The acronym that a word between blanks is, without what stands around it; null for other words."""
    core = F.regexp_replace(F.regexp_replace(raw, r"^[\"'“‘(\[{<]+", ""), r"(?<![\"'”’)\]}>,:;!?])[\"'”’)\]}>,:;!?]++$", "")
    return let(F.when(core.rlike(SHAPE), core).otherwise(F.regexp_replace(core, r"\.$", "")), lambda c: F.when(c.rlike(SHAPE), c))


def in_capitals(raw: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(raw, "^[^A-Za-z]+", ""), "(?<![^A-Za-z.])[^A-Za-z.]++$", "")
    return let(core, lambda c: c.rlike(SHAPE) | c.rlike("^[A-Z]{2,}$"))


def _raw_words(b: Column) -> Column:
    """(line, at, raw) of a block's words, in order."""
    lines = F.split(F.replace(b.getField("text"), F.lit("\x04"), F.lit("")), "\n")
    return F.flatten(F.transform(lines, lambda t, k: F.transform(_words(t), lambda w, i: F.struct((b.getField("line") + k).alias("line"), i.alias("at"), w.alias("raw")))))


def _near(words: Column) -> Column:
    """The words with capitals in a row and those around them that decide about them. Where others are left out, words
    without such capitals stand on both sides, so that runs of capitals stay apart."""
    hot = F.filter(F.transform(words, lambda x, i: F.when(x.getField("raw").rlike(HOT), i)), lambda i: i.isNotNull())
    around = lambda i: F.sequence(F.greatest(i - BACK, F.lit(0)), F.least(i + AHEAD, F.size(words) - 1))
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(hot, around))))
    return F.transform(places, lambda i: F.get(words, i))


def _judged(words: Column, common: Test, brackets: Column) -> Column:
    """Adds what each word alone decides. Only words with capitals in a row are looked at closely; initials are needed
    in blocks with brackets."""

    def one(x: Column) -> Column:
        raw = x.getField("raw")
        hot = raw.rlike(HOT)
        # Most are letters with marks behind them at most, of which nothing has to be searched for.
        core = F.rtrim(raw, F.lit(",:;!?"))
        token, caps = F.when(hot, token_of(raw)), hot & in_capitals(raw)
        slow = F.struct(token.alias("token"), caps.alias("caps"), F.lower(bare(raw)).alias("bare"))
        fast = lambda c: F.struct(F.when(F.length(c) <= 6, c).alias("token"), F.lit(True).alias("caps"), F.lower(c).alias("bare"))
        return let(
            let(core, lambda c: F.when(c.rlike("^[A-Z]{2,}$"), fast(c)).otherwise(slow)),
            lambda j: F.struct(
                x.getField("line").alias("line"), x.getField("at").alias("at"), raw.alias("raw"), j.getField("token").alias("token"), j.getField("caps").alias("caps"),
                (j.getField("caps") | j.getField("token").isNotNull()) & common(j.getField("bare")),
                raw.startswith("(").alias("opens"), raw.contains(")").alias("closes"), F.when(brackets, word_initials(raw)).otherwise("").alias("ini"),
            ),
        )

    kind = "array<struct<line:int,at:int,raw:string,token:string,caps:boolean,common:boolean,opens:boolean,closes:boolean,ini:string>>"
    return F.transform(words, one).cast(kind)


def _shouted(words: Column) -> Column:
    """For each word whether it is part of a run of capitals that is shouting: mostly everyday words. In the class
    string C is an everyday word in capitals, c another one, and a point any other word."""
    classes = F.array_join(F.transform(words, lambda x: F.when(x.getField("caps") & x.getField("common"), "C").when(x.getField("caps"), "c").otherwise(".")), "")

    def verdict(run: Column) -> Column:
        n, usual = F.length(run), F.length(F.replace(run, F.lit("c"), F.lit("")))
        return ~run.startswith(".") & (n >= 2) & F.when(n == 2, usual == 2).otherwise(2 * usual >= n)

    return F.flatten(F.transform(F.regexp_extract_all(classes, F.lit("[Cc]++|[.]++"), F.lit(0)), lambda run: F.array_repeat(verdict(run), F.length(run))))


def _numeral(words: Column, i: Column, key: Column, common: Test) -> Column:
    """Numbering words or titles up to three words back, a name just before, or a clear numeral beside."""

    def judge(near: Column) -> Column:
        back = [near.getField(f"b{k}") for k in range(1, 6)]
        clear = lambda c: (F.length(c) >= 4) & c.rlike(lex.ROMAN) & ~c.isin(lex.NUMERAL_EXCEPTIONS)
        numbering = lambda c: F.lower(c).isin(lex.NUMBERING)
        name = back[0].rlike("^[A-Z][a-z]{4,}$") & ~common(F.lower(back[0])) & ~numbering(back[0])
        listed = lambda k: back[k].rlike(lex.ROMAN) & (back[k] != "") & numbering(back[k + 1])
        joined = F.lower(back[0]).isin("and", "or", "to", "through") & (listed(1) | listed(2) | listed(3) | clear(back[1]) | clear(back[2]) | clear(back[3]))
        titles = lambda k: numbering(back[k]) | back[k].isin(lex.NAMED_BY_NUMERAL)
        return clear(key) | titles(0) | titles(1) | titles(2) | name | clear(back[0]) | clear(near.getField("after")) | joined

    at = lambda k: F.coalesce(bare(F.get(words, i + k).getField("raw")), F.lit(""))
    near = F.struct(*(at(-k).alias(f"b{k}") for k in range(1, 6)), at(1).alias("after"))
    return F.when(key.rlike(lex.ROMAN), let(near, judge)).otherwise(False)


def _candidates(words: Column, known: list[str], common: Test) -> Column:
    """Adds key and shouted to the words that may be uses (key is null for all others), and their place."""

    def mark(shouted: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            key = F.replace(x.getField("token"), F.lit("."), F.lit(""))
            use = x.getField("token").isNotNull() & ~x.getField("common")
            key = F.when(use, let(key, lambda k: F.when(~k.isin(known) & ~_numeral(words, i, k, common), k)))
            return F.struct(*(x.getField(f).alias(f) for f in ("line", "at", "raw", "token", "opens", "closes", "ini")), i.alias("i"), key.alias("key"), F.get(shouted, i).alias("shouted"))

        return F.transform(words, one)

    return let(_shouted(words), mark)


def _counts(x: Column) -> Column:
    """Whether a word is one of the short array: it has an initial, closes a bracket or may be a use."""
    return (x.getField("ini") != "") | x.getField("closes") | x.getField("key").isNotNull()


def _expanded(words: Column, short: Column, x: Column, j: Column, spare: Column) -> Column:
    """Whether a bracket that opens one of the next three words spells the acronym up to its first closing one. j: the
    word's place in the short array; spare: how many words of that array may have no initial."""
    key, i = x.getField("key"), x.getField("i")
    word = lambda k: F.get(words, i + k)
    opens = lambda k: F.coalesce(word(k).getField("opens"), F.lit(False))
    ahead = F.when(opens(1), 1).when(opens(2), 2).when(opens(3), 3)

    def spelt(k: Column) -> Column:
        raw = F.substr(word(k).getField("raw"), F.lit(2))
        skipped = sum((F.when((k >= n) & _counts(word(n)), 1).otherwise(0) for n in (1, 2, 3)), F.lit(0))

        def within(rest: Column) -> Column:
            ends = F.get(F.filter(F.transform(rest, lambda e, n: F.when(e.getField("closes"), n)), lambda n: n.isNotNull()), F.lit(0))
            whole = lambda n: F.concat(initials(raw), F.array_join(F.transform(F.slice(rest, F.lit(1), n), lambda e: e.getField("ini")), ""), initials(F.substring_index(F.get(rest, n).getField("raw"), ")", 1)))
            return let(ends, lambda n: F.when(n.isNotNull(), whole(n)))

        inside = let(F.slice(short, j + skipped + 2, F.length(key) + 1 + spare), within)
        return F.when(raw.contains(")"), initials(F.substring_index(raw, ")", 1))).otherwise(inside)

    return let(ahead, lambda k: F.coalesce(F.when(k.isNotNull(), spelt(k) == key), F.lit(False)))


def _uses(b: Column, known: list[str], common: Test) -> Column:
    """A block's entries: uses, and acronyms that a bracket behind them spells."""

    def entries(words: Column, brackets: Column) -> Column:
        def of_short(short: Column) -> Column:
            def one(x: Column, j: Column, spare: Column) -> Column:
                kind = F.when(brackets & _expanded(words, short, x, j, spare), SAID).when(~x.getField("shouted"), USED)
                return F.when(x.getField("key").isNotNull(), let(kind, lambda k: F.when(k.isNotNull(), _event(x.getField("key"), x.getField("line"), x.getField("at"), k, x.getField("token")))))

            blank = F.size(F.filter(short, lambda x: (x.getField("ini") == "") & ~x.getField("closes")))
            return let(blank, lambda spare: F.filter(F.transform(short, lambda x, j: one(x, j, spare)), lambda e: e.isNotNull()))

        return let(F.filter(words, _counts), of_short)

    def of_words(brackets: Column) -> Column:
        words = let(_raw_words(b), lambda w: F.when(brackets, w).otherwise(_near(w)))
        judged = _judged(words, common, brackets)
        return let(judged, lambda w: let(_candidates(w, known, common), lambda c: entries(c, brackets)))

    # Whether a bracket may explain an acronym is asked once, not for each word.
    text = F.replace(b.getField("text"), F.lit("\x04"), F.lit(""))
    return let(text.contains("(") & text.rlike(EXPLAINED), of_words)


def _definitions() -> Column:
    """`Alpha Beta Charlie (ABC)` in the lines that show; a plain document's are those of its blocks. Small words don't
    count, so words without an initial go before the last few are read."""
    line_of = lambda line, text: F.struct(line.alias("line"), text.alias("text"))
    plain = F.flatten(F.transform("blocks", lambda b: F.transform(F.split(b.getField("text"), "\n"), lambda t, k: line_of(b.getField("line") + k, t))))
    lines = F.filter(F.when(F.size("rows") > 0, F.transform("rows", lambda r: line_of(r.getField("line"), r.getField("text")))).otherwise(plain), lambda x: x.getField("text").rlike(DEFINED))

    def of_line(x: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            return F.struct(i.alias("at"), initials(w).alias("ini"), F.replace(F.regexp_extract(w, DEFINED, 1), F.lit("."), F.lit("")).alias("key"), initials(F.substring_index(w, "(", 1)).alias("front"))

        def spelt(words: Column) -> Column:
            def one(w: Column, j: Column) -> Column:
                before = F.concat(F.array_join(F.transform(F.slice(words, F.greatest(j - 11, F.lit(1)), F.least(j, F.lit(12))), lambda y: y.getField("ini")), ""), w.getField("front"))
                n = F.length(w.getField("key"))
                return F.when((n > 0) & (F.substr(before, F.greatest(F.length(before) - n + 1, F.lit(1)), n) == w.getField("key")), w)

            return F.filter(F.transform(words, one), lambda w: w.isNotNull())

        kept = F.filter(F.transform(_words(x.getField("text")), word), lambda w: (w.getField("ini") != "") | (w.getField("key") != ""))
        return F.transform(let(kept, spelt), lambda w: _event(w.getField("key"), x.getField("line"), w.getField("at"), F.lit(SAID), F.lit("")))

    return F.flatten(F.transform(lines, of_line))


def undefined(known: list[str] | None = None, common: Test | None = None) -> Column:
    """The rule's findings in a parsed document, in order of acronyms."""
    test = common or listed(everyday())
    every = [*lex.KNOWN_ACRONYMS, *(known or [])]

    def asks(text: Column) -> Column:
        """Whether a block has an acronym that is neither known nor an everyday word; all others have no entry."""
        keys = F.transform(F.regexp_extract_all(F.replace(text, F.lit("\x04"), F.lit("")), F.lit(SPELT), F.lit(1)), lambda t: F.replace(t, F.lit("."), F.lit("")))
        return F.exists(F.array_distinct(keys), lambda k: ~k.isin(every) & ~test(F.lower(k)))

    uses = F.flatten(F.transform(F.filter("blocks", lambda b: b.getField("text").rlike(CANDIDATE) & asks(b.getField("text"))), lambda b: _uses(b, every, test)))

    def first(events: Column) -> Column:
        def one(e: Column, n: Column) -> Column:
            begins = (n == 0) | (F.get(events, n - 1).getField("key") != e.getField("key"))
            detail = F.concat(F.lit('define acronym "'), e.getField("token"), F.lit('" on first use'))
            return F.when(begins & (e.getField("kind") == USED), F.struct(e.getField("line").cast("int").alias("line"), detail.alias("detail"), e.getField("pos").alias("ord")))

        return F.filter(F.transform(events, one), lambda x: x.isNotNull())

    found = lambda u: let(F.sort_array(F.concat(u, _definitions())), first)
    return let(uses, lambda u: F.when(F.size(u) > 0, found(u)).otherwise(F.array().cast("array<struct<line:int,detail:string,ord:bigint>>")))


def listed(words: list[str] | tuple[str, ...]) -> Test:
    """A test for the words of a list. Small words are everyday words in any list."""
    # One text of parts, in each the words of one checksum with a mark around them: a plan of one literal, however long
    # the list, of which a word is looked up in a few characters.
    every = {w for w in (*words, *lex.EXPANSION_STOP_WORDS) if MARK not in w and PART not in w}
    n = len(every) // 2 + 1
    parts = [""] * n
    for w in sorted(every):
        k = zlib.crc32(w.encode()) % n
        parts[k] = (parts[k] or MARK) + w + MARK
    table = F.split(F.lit(PART.join(parts)), PART)
    return lambda w: F.get(table, F.crc32(w) % n).contains(F.concat(F.lit(MARK), w, F.lit(MARK))) & (w != "")


def everyday_test(rows: DataFrame, common: list[str] | tuple[str, ...] | DataFrame | None) -> tuple[DataFrame, Test, tuple[str, ...] | None]:
    """Parsed documents, the test for everyday words, and the words if they are part of the plan. A list, or a table (word) of up to LISTED rows, is part of the
    plan. A larger table is joined with the words that are asked for; each document then carries those of its own."""
    if not isinstance(common, DataFrame):
        words = everyday() if common is None else tuple(sorted(set(common)))
        return rows, listed(words), words
    table = common.select("word").where("word is not null").distinct()
    few = [r.word for r in table.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return rows, listed(few), tuple(sorted(few))
    hot = F.filter("blocks", lambda b: b.getField("text").rlike(CANDIDATE))

    def asked(b: Column) -> Column:
        by = lambda w: F.transform(w, lambda x, i: F.when(x.getField("raw").rlike("[A-Z]{2}|[A-Z][.][A-Z]") | F.coalesce(F.get(w, i + 1).getField("raw").rlike("[A-Z]{2}|[A-Z][.][A-Z]"), F.lit(False)), F.lower(bare(x.getField("raw")))))
        return let(_raw_words(b), by)

    asked_for = barrier(rows.select("doc", F.array_distinct(F.flatten(F.transform(hot, asked))).alias("w"))).select("doc", F.explode("w").alias("word")).distinct()
    of = asked_for.join(table, "word", "left_semi").groupBy("doc").agg(F.collect_set("word").alias("everyday")).withColumnRenamed("doc", "d")
    joined = rows.join(of, rows.doc.eqNullSafe(of.d), "left").drop("d")
    small = list(lex.EXPANSION_STOP_WORDS)
    return joined, lambda w: w.isin(small) | F.coalesce(F.array_contains(F.col("everyday"), w), F.lit(False)), None


def acronym_undefined(corpus: DataFrame, common: list[str] | DataFrame | None = None, known: list[str] | None = None) -> DataFrame:
    """Violations of acronym-undefined alone; known are the project's own acronyms."""
    from prosegauge.plans.audit import audit

    return audit(corpus, common, known, only=["acronym-undefined"])
