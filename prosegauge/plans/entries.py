"""What a user starts: audits of a corpus or a single target, evidence sweeps, maturity scores, the gap report; and the
JSON that they hand to one another.

Findings are made and sorted by Spark. `write_findings` stores them as JSON lines, a row a document, at any size; the
single JSON file of `findings_file` is written document by document from an iterator over partitions, so the driver
holds one partition at a time. All else that is written is small by nature: rules, categories, dimensions, audits.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.functions.text import config_hash, table_cell
from prosegauge.operators import governance
from prosegauge.plans.audit import audit, findings, sorted_violations
from prosegauge.sources.corpus import documents, project_acronyms, read_answers, read_folder, skipped

ACRONYMS = ".prosegauge/acronyms.json"


class Audit:
    """One audit of a folder or a file. The folder is read once; a file's name is relative to the project."""

    def __init__(self, spark: SparkSession, target: str, project: str | None = None) -> None:
        rows = read_folder(spark, target)
        if project is not None:
            # A whole folder keeps its names below the project, as does a single file.
            base = os.path.relpath(target if os.path.isdir(target) else os.path.dirname(target) or ".", project).replace(os.sep, "/")
            rows = rows.withColumn("path", F.col("path") if base == "." else F.concat(F.lit(f"{base}/"), "path"))
        self.rows = rows.persist()
        self.corpus, self.skipped = documents(self.rows), skipped(self.rows)
        folder = project if project is not None else target
        self.found = audit(self.corpus, known=project_acronyms(spark, f"{folder}/{ACRONYMS}")).persist()

    def totals(self) -> list[tuple[str, int]]:
        """Counts by rule, in the order in which the rules first occur."""
        per = self.found.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.struct("doc", "phase", "ord")).alias("first"))
        return [(r.rule, r.n) for r in per.orderBy("first").collect()]

    def table(self) -> Iterator[str]:
        """A Markdown row for each finding."""
        rows = sorted_violations(self.found).select(F.concat(F.lit("| "), F.concat_ws(" | ", table_cell(F.col("doc")), F.col("line").cast("string"), "rule", table_cell(F.col("detail"))), F.lit(" |")).alias("row"))
        yield from ["| File | Line | Rule | Finding |", "|---|---|---|---|"]
        yield from (r.row for r in rows.toLocalIterator())
        yield ""
        yield f"Findings: {self.found.count()}. Files read: {self.corpus.count()}. Skipped: {self.skipped.count()}."
        yield "Findings are mechanical proxies and no judgement; people decide what suits their readers."

    def close(self) -> None:
        self.found.unpersist()
        self.rows.unpersist()


def write_findings(audit_: Audit, folder: str) -> None:
    """JSON lines below a folder that every machine reaches: files, totals and skipped."""
    findings(audit_.corpus, audit_.found).write.mode("overwrite").json(f"{folder}/files")
    audit_.found.groupBy("rule").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{folder}/totals")
    audit_.skipped.write.mode("overwrite").json(f"{folder}/skipped")


def findings_file(audit_: Audit, path: str) -> None:
    """One JSON object {configHash, files, totals, skipped}, written as the documents come."""
    totals = dict(audit_.totals())
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "configHash": "{config_hash()}",\n  "files": {{')
        for k, r in enumerate(findings(audit_.corpus, audit_.found).orderBy("path").toLocalIterator()):
            body = {"violations": [v.asDict() for v in r.violations]}
            f.write(f"{',' if k else ''}\n    {json.dumps(r.path, ensure_ascii=False)}: {json.dumps(body, ensure_ascii=False)}")
        missed = [r.path for r in audit_.skipped.orderBy("path").toLocalIterator()]
        f.write(f'\n  }},\n  "totals": {json.dumps(totals)},\n  "skipped": {json.dumps(missed, ensure_ascii=False)}\n}}\n')


def evidence(spark: SparkSession, folder: str) -> dict:
    """{artefacts: {category: {found, paths}}} of a folder."""
    rows = read_folder(spark, folder, "all").where("error is null")
    found = governance.evidence(rows.select("path", F.col("text").alias("content")))
    paths = {r.category: r.paths for r in found.groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()}
    return {"artefacts": {c: {"found": c in paths, "paths": paths.get(c, [])} for c in lex.EVIDENCE}}


def maturity(spark: SparkSession, answers: str) -> dict:
    """{dimensions: {dimension: {level, missing}}, overall} of a file of answers; without any, all levels are 0."""
    given = read_answers(spark, answers)
    levels = {r.dimension: r for r in governance.maturity(given).collect()}
    per = {d: {"level": levels[d].level if d in levels else 0, "missing": [m for m in [levels[d].missing if d in levels else c[0]] if m]} for d, c in lex.MATURITY.items()}
    return {"dimensions": per, "overall": min(x["level"] for x in per.values())}


def gap_report(totals: dict[str, int], evidence_: dict, maturity_: dict, snapshots: list[dict], now: str) -> tuple[str, list[dict]]:
    """The report of one organisation, and the history with this audit at its end."""
    from prosegauge.plans.report import _table

    snapshots = [*snapshots, {"timestamp": now, "totals": dict(totals), "overall": maturity_["overall"]}]
    lines = ["# Plain language gap analysis", "", f"> Provisional: findings are mechanical proxies and never a statement of conformance. Audit date: {now}.", "", "## Maturity", ""]
    lines += _table(["Dimension", "Level", "Blocking criteria"], [[d, r["level"], ", ".join(r["missing"]) or "-"] for d, r in maturity_["dimensions"].items()])
    lines += ["", f"Overall maturity (weakest dimension): **{maturity_['overall']}**.", "", "## Evidence", ""]
    lines += _table(["Category", "Found", "Paths"], [[c, "yes" if a["found"] else "no", "<br>".join(a["paths"]) or "-"] for c, a in evidence_["artefacts"].items()])
    lines += ["", "## Corpus findings", "", *_table(["Rule", "Violations"], [[r, n] for r, n in totals.items()]), "", "Corpus metrics are proxies for measurement alone and raise no level."]
    if len(snapshots) >= 2:
        lines += ["", "## Trend", "", *_table(["Audit date", "Overall", "Total violations"], [[s["timestamp"], s["overall"], sum(s["totals"].values())] for s in snapshots])]
    lines += ["", "## Limitations", "", "- Heuristics on text are made for English and approximate.", "- Absent evidence scores as absent.", "- A person must review this report before anyone acts on it.", ""]
    return "\n".join(lines), snapshots
