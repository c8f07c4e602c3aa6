"""A terse word after each write: one line for each rule that a batch of written documents breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosegauge.functions.lexicon import RULES
from prosegauge.plans.audit import audit


def terse(violations: DataFrame) -> DataFrame:
    """(rule, n, n_docs, first): one row for each rule, with one place where it is broken. At most as many rows as
    there are rules."""
    at = F.min(F.struct("doc", "line")).alias("at")
    rows = violations.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"), at)
    return rows.select("rule", "n", "n_docs", F.concat_ws(":", F.col("at.doc").cast("string"), F.col("at.line").cast("string")).alias("first"))


def after_write(stream: DataFrame, say: Callable[[str], None], checkpoint: str, on: bool = True, rules: list[str] | None = None) -> StreamingQuery:
    """Audits each batch of written documents (doc, text) and says one line for each rule. It only tells: a failing
    audit is told too and never stops the stream. With on=False nothing is audited."""

    def batch(rows: DataFrame, number: int) -> None:
        if not on:
            return
        try:
            found = {r.rule: r for r in terse(audit(rows.select("doc", "text"), only=rules)).collect()}
        except Exception as e:  # advice must not block what it advises on
            say(f"audit failed: {type(e).__name__}")
            return
        for rule in RULES:
            if rule in found:
                say(f"{rule}: {found[rule].n} in {found[rule].n_docs} documents, first at {found[rule].first}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
