"""A whole audit: all rules over a corpus, totals, files, findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.lexicon import RULES
from prosegauge.functions.text import barrier, config_hash
from prosegauge.operators import rules
from prosegauge.operators.acronyms import everyday_test, undefined
from prosegauge.operators.rules import ON_PHRASES, ON_SENTENCES
from prosegauge.operators.sentences import MARKS, measured, settled
from prosegauge.operators.structure import Parsed, parsed

ACRONYM = "acronym-undefined"
#: Rules and the look (`prosegauge.operators.structure.parsed`) without which they have no finding.
LOOKS = {ACRONYM: "acronyms", "prose-enumeration": "ranks", "filler-opening": "openers", "table-header": "tables"}
#: Rule -> its column of findings.
OPERATORS = rules.OPERATORS


def prepared(rows: DataFrame, names: list[str]) -> DataFrame:
    """Parsed documents with what the named rules share: marks (sentences of each block) and hot (blocks with phrases that patterns look for)."""
    more = []
    if ON_SENTENCES & set(names):
        whole = F.array(settled(F.col("sentences"), F.col("doubts")))
        parts = F.transform("parts", lambda p: settled(p.getField("sentences"), p.getField("doubts"), p.getField("line")))
        # No rule has a finding in the sentences of a text that is not lengthy.
        more.append(F.when(~F.col("lengthy"), F.array().cast(MARKS)).when(F.col("sentences").isNotNull(), whole).when(F.col("parts").isNotNull(), parts).otherwise(F.transform("blocks", measured)).alias("marks"))
    if ON_PHRASES & set(names):
        found = F.filter("blocks", lambda b: b.getField("text").rlike(rules.ANY_PHRASE))
        more.append(F.when(F.col("searched"), found).otherwise(F.filter("blocks", lambda b: F.lit(False))).alias("hot"))
    return barrier(rows.select("*", *more)) if more else rows


def _named(rule: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rule).alias("rule"), x.getField("line").alias("line"), x.getField("detail").alias("detail"), F.lit(RULES.index(rule)).alias("phase"), x.getField("ord").alias("ord")))


_built: dict[tuple, Column] = {}


def built(rows: DataFrame, key: tuple, make: Callable[[], Column]) -> Column:
    """The same column without building it again: columns name no table, and a rule's takes long to put together."""
    key = (rows.sparkSession.sparkContext.applicationId, *key)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def gated(columns: dict[str, Callable[[], Column]]) -> dict[str, Callable[[], Column]]:
    """The columns of rules that a first look at the text tells to have no finding, under that look."""
    under = lambda name, make: lambda: rules.optional(F.col(name), make())
    return columns | {rule: under(name, columns[rule]) for rule, name in LOOKS.items() if rule in columns}


def document_findings(rows: DataFrame, names: list[str], columns: dict[str, Callable[[], Column]] = OPERATORS, of: tuple = ()) -> DataFrame:
    """(doc, rule, line, detail, phase, ord) of the named rules over parsed documents: one scan, no shuffle. of: what
    the columns were made from, where they are not OPERATORS alone."""
    columns = gated(columns)
    found = built(rows, (*names, of), lambda: F.flatten(F.array(*(_named(n, columns[n]()) for n in names))))
    return barrier(prepared(rows, names).select("doc", found.alias("found"))).select("doc", F.inline("found"))


def audit(corpus: DataFrame, common: list[str] | DataFrame | None = None, known: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(doc, rule, line, detail, phase, ord) of a corpus (doc, text). common: everyday words for the acronym rule, a
    list or a table (word), by default `prosegauge.functions.everyday`; known: the project's acronyms; only: the rules
    to run."""
    rows, columns, of = parsed(corpus), OPERATORS, ()
    names = [n for n in RULES if only is None or n in only]
    if ACRONYM in names:
        rows, test, words = everyday_test(rows, common)
        columns, of = OPERATORS | {ACRONYM: lambda: undefined(known, test)}, (tuple(known or ()), words)
    return document_findings(rows, names, columns, of)


def document_counts(corpus: DataFrame, common: list[str] | DataFrame | None = None, known: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(doc, counts) of every document, counts being a map from each rule to the number of its findings. One row in,
    one row out, so it works on streams too."""
    names = [n for n in RULES if only is None or n in only]
    rows, test, words = everyday_test(parsed(corpus), common)
    columns = gated(OPERATORS | {ACRONYM: lambda: undefined(known, test)})
    sizes = lambda: F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.size(columns[n]()) for n in names)))
    return prepared(rows, names).select("doc", built(rows, ("counts", *names, tuple(known or ()), words), sizes).alias("counts"))


def totals(violations: DataFrame) -> DataFrame:
    """(rule, n); rules without a finding have no row."""
    return violations.groupBy("rule").agg(F.count("*").alias("n"))


def files(corpus: DataFrame, violations: DataFrame) -> DataFrame:
    """(doc, n_violations, n_rules) of every document, clean ones included."""
    found = violations.groupBy("doc", "rule").agg(F.count("*").alias("n")).groupBy("doc").agg(F.sum("n").alias("n"), F.count("*").alias("rules"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return corpus.select("doc").join(found, "doc", "left").select("doc", zero(F.col("n")).alias("n_violations"), zero(F.col("rules")).alias("n_rules"))


def findings(corpus: DataFrame, violations: DataFrame) -> DataFrame:
    """(configHash, path, violations): one row a document, its violations in report order, as the JSON sink writes it.
    Only the violations of one document meet in a row."""
    item = F.struct("phase", "ord", "rule", "line", "detail")
    per = violations.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x.getField("rule").alias("rule"), x.getField("line").alias("line"), x.getField("detail").alias("detail"))).alias("violations"))
    empty = F.array().cast("array<struct<rule:string,line:int,detail:string>>")
    return corpus.select("doc").join(per, "doc", "left").select(F.lit(config_hash()).alias("configHash"), F.col("doc").alias("path"), F.coalesce("violations", empty).alias("violations"))


def sorted_violations(violations: DataFrame) -> DataFrame:
    return violations.orderBy("doc", "phase", "ord")
