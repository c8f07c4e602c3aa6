"""A running audit: documents as they arrive, findings and changes appended for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosegauge.plans.audit import audit


def monitor(stream: DataFrame, out: str, checkpoint: str, common: DataFrame | None = None, rules: list[str] | None = None) -> StreamingQuery:
    """Audits each batch of a stream (doc, text) and appends its findings to out/violations and counts for each
    document and rule to out/counts, both with the number of the batch. A batch that runs again replaces its own
    folder, so a restart neither loses nor repeats it."""

    def batch(rows: DataFrame, number: int) -> None:
        found = audit(rows.select("doc", "text"), common=common, only=rules)
        found.write.mode("overwrite").parquet(f"{out}/violations/batch={number}")
        docs = rows.select("doc").distinct()
        counted = spark_counts(docs, rows.sparkSession.read.parquet(f"{out}/violations/batch={number}"))
        counted.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spark_counts(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """(doc, rule, n); a clean document has one row with a null rule and 0."""
    per = violations.groupBy("doc", "rule").agg(F.count("*").alias("n"))
    return docs.join(per, "doc", "left").select("doc", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def changes(counts: DataFrame) -> DataFrame:
    """(doc, batch, rule, change) against the batch before that held the document. A document's first batch is its
    silent baseline; rules that went away count as decreases."""
    from pyspark.sql import Window

    seen = counts.select("doc", "batch").distinct()
    rules = counts.where("rule is not null").select("doc", "rule").distinct()
    full = seen.join(rules, "doc").join(counts, ["doc", "batch", "rule"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("doc", "rule").orderBy("batch")
    return full.select("doc", "batch", "rule", (F.col("n") - F.lag("n").over(w)).alias("change")).where("change <> 0")
