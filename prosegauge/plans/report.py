"""The gap report, and the append-only history of audits behind its trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.lexicon import EVIDENCE, RULES


def append_snapshot(totals: DataFrame, overall: int, timestamp: str, path: str) -> None:
    """Adds one audit to the history: a row for each rule found, or one row without a rule for a clean corpus."""
    spark = totals.sparkSession
    one = spark.createDataFrame([(timestamp, overall)], "timestamp string, overall int")
    one.join(totals.select("rule", "n"), F.lit(True), "left").write.mode("append").parquet(path)


def history(snapshots: DataFrame) -> DataFrame:
    """(timestamp, overall, total) of each audit."""
    return snapshots.groupBy("timestamp", "overall").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def cell(value: object) -> str:
    return " ".join(str(value).replace("|", "\\|").splitlines())


def _table(head: list[str], rows: list[list]) -> list[str]:
    return [f"| {' | '.join(head)} |", "|" + "---|" * len(head), *(f"| {' | '.join(map(cell, r))} |" for r in rows)]


def markdown(totals: DataFrame, evidence: DataFrame, maturity: DataFrame, snapshots: DataFrame) -> str:
    """The report of one organisation. All inputs are small by nature: rules, categories, dimensions and audits."""
    levels = maturity.orderBy("dim_ord").collect()
    found = {r.category: r for r in evidence.collect()}
    counts = {r.rule: r.n for r in totals.collect()}
    audits = history(snapshots).orderBy("timestamp").collect()
    lines = ["# Plain language gap analysis", "", "> Findings are mechanical proxies and never a statement of conformance.", "", "## Maturity", ""]
    lines += _table(["Dimension", "Level", "Blocking criteria"], [[r.dimension, r.level, r.missing or "-"] for r in levels])
    lines += ["", f"Overall maturity (weakest dimension): **{min((r.level for r in levels), default=0)}**.", "", "## Evidence", ""]
    lines += _table(["Category", "Found", "Paths"], [[c, "yes" if c in found and found[c].found else "no", found[c].n_paths if c in found else 0] for c in EVIDENCE])
    lines += ["", "## Corpus findings", "", *_table(["Rule", "Violations"], [[r, counts[r]] for r in RULES if r in counts])]
    if len(audits) >= 2:
        lines += ["", "## Trend", "", *_table(["Audit", "Overall", "Total violations"], [[r.timestamp, r.overall, r.total] for r in audits])]
    return "\n".join([*lines, "", "## Limitations", "", "- Heuristics on text are made for English and approximate.", "- A person must review this report before anyone acts on it.", ""])
