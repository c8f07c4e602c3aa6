"""Phrases from a table of any size: a join of word n-grams, then the longest phrases that do not overlap.

A pattern of all phrases serves for the shipped lists; a project's own lexicon may hold a hundred thousand. Blocks are
cut into words and what stands between them. A phrase is found where its words, and all between them, stand in a row,
in any case, with any white space for a blank; so each run of as many words as some phrase has is looked up in the
table by an equality join. Of found phrases that overlap the longer one stays, then the one of lesser rank, then the
first: of a block's matches, in that order, each is kept whose words are still free.

A phrase that quotes or backticks hold alone is named and not used. Phrases without a word are never found; of phrases
that are the same but for case and white space the one of least rank counts; null phrases are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from prosegauge.functions.text import WS, barrier, let
from prosegauge.operators.structure import parsed

WORD, BETWEEN = "[A-Za-z0-9_]+", "[^A-Za-z0-9_]+"
#: Tables up to this size are sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_PHRASES = 200_000
#: Stands inside the marks of a quoted span.
INNER = "\x05"
#: Spans in quotes or backticks, paired from the left: mark, inner text, mark.
QUOTED = "(`)([^`]*+)(`)|([“”\"])([^“”\"]*+)([“”\"])|(')([^']*+)(')|(‘)([^’]*+)(’)"


def _squashed(between: Column) -> Column:
    return F.when(between.rlike(f"^[{WS}]+$"), " ").otherwise(F.replace(between, F.lit(INNER), F.lit("")))


def _cut(text: Column) -> Column:
    """words, each in lower case; gaps, what stands before each word and behind the last."""
    return F.struct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower).alias("words"), F.split(text, WORD).alias("gaps"))


def _runs(cut: Column, sizes: list[int]) -> Column:
    """(at, size, key) of all runs of so many words that no span holds alone. key is the run as the table has it."""
    words, gaps = cut.getField("words"), cut.getField("gaps")
    joined = F.transform(words, lambda w, i: F.concat(w, _squashed(F.get(gaps, i + 1))))

    def of_size(parts: Column, n: int) -> Column:
        def one(i: Column) -> Column:
            key = F.concat(F.array_join(F.slice(parts, i + 1, F.lit(n - 1)), "") if n > 1 else F.lit(""), F.get(words, i + n - 1))
            named = F.get(gaps, i).rlike(rf"{INNER}[\t\x0B\f\r ]*$") & F.get(gaps, i + n).rlike(rf"^[\t\x0B\f\r ]*{INNER}")
            return F.when(~named, F.struct(i.alias("at"), F.lit(n).alias("size"), key.alias("key")))

        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, one), lambda x: x.isNotNull())

    return let(joined, lambda parts: F.flatten(F.array(*(of_size(parts, n) for n in sizes))))


def table(lexicon: DataFrame) -> DataFrame:
    """(key, size, rank, phrase, detail) of a lexicon (phrase, rank, detail), one row a key."""
    cut = lexicon.where("phrase is not null").select("phrase", "rank", "detail", _cut(F.trim("phrase")).alias("c"))
    words, gaps = F.col("c.words"), F.col("c.gaps")
    key = F.array_join(F.transform(words, lambda w, i: F.concat(w, F.when(i < F.size(words) - 1, _squashed(F.get(gaps, i + 1))).otherwise(F.lit("")))), "")
    rows = cut.where(F.size(words) > 0).select(key.alias("key"), F.size(words).alias("size"), F.struct("rank", "phrase", "detail").alias("of"))
    return rows.groupBy("key", "size").agg(F.min("of").alias("of")).select("key", "size", "of.*")


_match = pa.struct([("size", pa.int32()), ("rank", pa.int64()), ("at", pa.int32()), ("line", pa.int32()), ("detail", pa.string())])


@F.arrow_udf(from_arrow_type(pa.list_(_match)))
def apart(blocks: pa.Array) -> pa.Array:
    """Of each block's matches those that are kept, in order of place. Each word is taken once at most, so this is linear
    in what is kept but for the sort."""
    out = []
    for block in blocks:
        taken: set[int] = set()
        kept = []
        for m in sorted(block.as_py(), key=lambda m: (-m["size"], m["rank"], m["at"])):
            # Longer ones came before, so one that overlaps this covers one of its ends.
            if m["at"] not in taken and m["at"] + m["size"] - 1 not in taken:
                taken.update(range(m["at"], m["at"] + m["size"]))
                kept.append(m)
        out.append(sorted(kept, key=lambda m: m["at"]))
    return pa.array(out, pa.list_(_match))


def phrases(corpus: DataFrame, lexicon: DataFrame, rule: str) -> DataFrame:
    """(doc, rule, line, detail, ord) for each phrase of a lexicon (phrase, rank, detail) that a corpus uses."""
    entries = table(lexicon).persist()
    sizes = sorted(r["size"] for r in entries.select("size").distinct().collect())
    if not sizes:
        return corpus.sparkSession.createDataFrame([], f"doc {corpus.schema['doc'].dataType.simpleString()}, rule string, line int, detail string, ord bigint")
    small = entries.count() <= BROADCAST_PHRASES

    def of_block(b: Column) -> Column:
        text = F.regexp_replace(F.replace(b.getField("text"), F.lit("\x04"), F.lit("")), QUOTED, f"$1$4$7$10{INNER}$2$5$8$11{INNER}$3$6$9$12")
        lines = F.flatten(F.transform(F.split(b.getField("text"), "\n"), lambda l, k: F.array_repeat(b.getField("line") + k, F.size(F.regexp_extract_all(l, F.lit(WORD), F.lit(0))))))  # noqa: E741
        runs = let(_cut(text), lambda c: _runs(c, sizes))
        return let(lines, lambda held: F.transform(runs, lambda x: F.struct(b.getField("line").alias("block"), F.get(held, x.getField("at")).alias("line"), x.getField("at").alias("at"), x.getField("key").alias("key"))))

    rows = parsed(corpus).select("doc", F.monotonically_increasing_id().alias("row"), F.flatten(F.transform("blocks", of_block)).alias("runs"))
    runs = barrier(rows).select("doc", "row", F.inline("runs"))
    found = runs.join(F.broadcast(entries) if small else entries, "key")
    match = F.struct("size", F.col("rank").cast("bigint").alias("rank"), "at", "line", "detail")
    blocks = found.groupBy("row", "block").agg(F.first("doc").alias("doc"), F.collect_list(match).alias("m")).select("doc", "block", apart("m").alias("m"))
    kept = blocks.select("doc", "block", F.posexplode("m").alias("n", "x"))
    return kept.select("doc", F.lit(rule).alias("rule"), F.col("x.line").alias("line"), F.col("x.detail").alias("detail"), (F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("n")).alias("ord"))
