"""Sentences and findings of plain text as SQL table functions without Python, made from the library's own columns.

`register` adds `text_sentences(text)` and `text_findings(text)`, for `SELECT ... FROM docs, LATERAL text_sentences(text)`. Their bodies
are the SQL of the columns that DataFrame jobs use, so both ways give the same, and they are inlined into the plan of
the query that calls them. Text is read as plain paragraphs between blank lines; Markdown structure needs
`prosegauge.plans.audit.audit`. A null text is an empty one: it has no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.text import let
from prosegauge.operators import rules
from prosegauge.operators.acronyms import undefined
from prosegauge.operators.sentences import AMBIGUOUS, SPLIT, marked, measured, sentence_lines
from prosegauge.operators.structure import BLOCK, HEADING, LINK, normalised, plain_blocks
from prosegauge.plans.audit import ACRONYM, _named

#: Operators that a column's SQL writes as functions: they are functions under their quoted names.
_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`'])([=<>!+\-*/%&|^~]+|and|or|not|in|like|rlike)\(", re.S)


def sql_of(column: Column) -> str:
    """A column as SQL text."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


def _blocks() -> str:
    return sql_of(plain_blocks(normalised(F.col("t"))))


def sentences_sql() -> str:
    """Body of text_sentences(t): paragraph and line from 1, and the sentence, in the reading with most sentences."""

    def of_block(b: Column, k: Column) -> Column:
        def cut(m: Column) -> Column:
            parts = F.split(m, f"[{SPLIT}{AMBIGUOUS}]")
            return F.zip_with(sentence_lines(m), parts, lambda n, s: F.struct((k + 1).alias("paragraph"), (b.getField("line") + n).alias("line"), F.regexp_replace(F.replace(s, F.lit("\x03"), F.lit("")), "[\\s]+$", "").alias("sentence")))

        return let(marked(b.getField("text")), cut)

    every = sql_of(F.flatten(F.transform("blocks", of_block)))
    return f"SELECT paragraph, line, sentence FROM (SELECT inline({every}) FROM (SELECT {_blocks()} AS blocks))"


def findings_sql() -> str:
    """Body of text_findings(t): the rules that plain text can break."""
    on = {n: make for n, make in rules.OPERATORS.items() if n not in ("heading-depth", "heading-skip", "heading-style", "table-header", "link-text", "image-alt")}
    on[ACRONYM] = undefined
    found = sql_of(F.flatten(F.array(*(_named(n, make()) for n, make in on.items()))))
    marks = sql_of(F.transform("blocks", measured))
    hot = sql_of(F.filter("blocks", lambda b: b.getField("text").rlike(rules.ANY_PHRASE)))
    none = ", ".join(f"CAST(array() AS {kind}) AS {name}" for name, kind in (("headings", HEADING), ("rows", BLOCK), ("links", LINK), ("said", rules.SAID)))
    shared = f"SELECT blocks, {marks} AS marks, {hot} AS hot, {none}, '' AS markup FROM (SELECT {_blocks()} AS blocks)"
    return f"SELECT rule, line, detail FROM (SELECT inline({found}) FROM ({shared}))"


def register(spark: SparkSession) -> None:
    for head, body in (
        ("text_sentences(t STRING) RETURNS TABLE (paragraph INT, line INT, sentence STRING)", sentences_sql()),
        ("text_findings(t STRING) RETURNS TABLE (rule STRING, line INT, detail STRING)", findings_sql()),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
