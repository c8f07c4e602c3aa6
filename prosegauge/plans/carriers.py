"""Corpora (doc, text) that Spark derives from the given tables.

The tables' prose holds next to no Markdown and few of the phrases that rules look for, so these put the columns of
`part` and the rules' own phrases into Markdown, one document a row, phrases by the key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def pick(values: Iterable[str], key: str = "p_partkey") -> Column:
    values = list(values)
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _glue(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


ENUMERATIONS = ("First pack it, second seal it and third send it.", "Take (1) the box and (2) the label.", "Second comes tape, third string and fourth glue.", "First the box, 2) the tape and (4) the glue.")
#: What a heading carrier adds to its name, by the key.
ENDINGS = ("", ".", ". Then more", "...", " of the many parts that we list here in one long row for all", "*.*", "")
#: Structure of many kinds, by the key: what stands before and behind a sentence that breaks a rule.
FRAMES = (
    ("```\ncode\n```\n", ""), ("```\n", "\n```"), ("> ", "\n> more"), ("- one\n- ", ""), ("<!-- ", " -->"), ("<!--\n", "\n-->\n"), ("~~~\n```\n~~~\n", ""),
    ("Title\n=====\n", ""), ("1. ", "\n2. next"), ("<b>Note</b> ", ""), ("---\nkey: value\n---\n", ""), ("    code\n\n", ""), ("> [!NOTE]\n> ", ""), ("[a]: /b\n", ""),
)
#: The frames that hide what they hold.
HIDING = (1, 4, 5)


def part_texts() -> dict[str, Column]:
    """The texts made from a row of `part`."""
    k, name, number = F.col("p_partkey"), F.col("p_name"), F.col("p_partkey").cast("string")
    mark = F.repeat(F.lit("#"), (k % 6 + 1).cast("int"))
    opening = F.when(k % 17 < 15, pick(lex.FILLERS)).otherwise(F.lit("the box"))
    label = F.when(k % 4 == 0, "here").when(k % 4 == 1, "Click here").when(k % 4 == 2, "").otherwise(name)
    return {
        "phrases": _glue("The ", name, " team ", pick(lex.LEGALESE), " ship the item ", pick(lex.WORDY), " the plan.\nThis is ", pick(lex.DOUBLE_NEGATIVES), " news about ", pick(lex.DOUBLETS), " for all."),
        "openings": _glue(F.initcap(opening), ", the ", name, " is ready."),
        "enumerations": _glue("For the ", name, ": ", pick(ENUMERATIONS)),
        "headings": _glue("# Catalogue\n\n", mark, " ", name, pick(ENDINGS), "\n\nBody of the entry.\n\n## Parts ##\n\n", mark, "# Last"),
        "tables": _glue("Sizes:\n\n| name | ", F.when(k % 3 == 0, "").when(k % 3 == 1, "*size*").otherwise("**"), " |\n|---|:-:|\n| ", name, " | 1 |\n\nno | table | ", name),
        "links": _glue("See [", label, "](http://example.com/p/", number, ")\nand ![", F.when(k % 5 == 0, "").otherwise(name), "](i", number, ".png) or [www.example.com](q", number, ") too."),
        "framed": _glue(pick([a for a, _ in FRAMES]), "The ", name, " team ", pick(lex.LEGALESE), " go.", pick([b for _, b in FRAMES])),
    }


def part(name: str):  # noqa: ANN201
    """The corpus of one kind of text, one document a row of `part`."""

    def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), part_texts()[name].alias("text"))

    return corpus


def vague_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, a third of them with all link labels replaced by one that says nothing."""
    label = F.concat(F.lit(">"), pick(lex.VAGUE_LINKS, "page_id"), F.lit("</a>"))
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", F.lit(">[^<>]*</a>"), label)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), html.alias("text"))


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text) of all corpora, doc being name and key. The texts made from `part` share one scan."""
    made = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in part_texts().items()))).alias("x")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), made).select(F.concat_ws("/", "x.name", "doc").alias("doc"), "x.text")
    for name, corpus in {"documents": documents, "pages": vague_pages}.items():
        rows = rows.union(corpus(spark, sf_dir).select(F.concat_ws("/", F.lit(name), "doc").alias("doc"), "text"))
    return rows
