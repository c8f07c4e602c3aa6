"""Evidence sweeps, maturity levels and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex


def evidence(paths: DataFrame) -> DataFrame:
    """(category, path) of all paths (path, content) that are evidence of a category; content may be null where the
    path alone decides. One pass; each row meets the five categories in its own row."""
    name = F.lower("path")
    workflow = name.rlike(lex.WORKFLOW_PATH) & F.coalesce(F.lower("content").rlike(lex.WORKFLOW_CONTENT), F.lit(False))
    hit = [F.when(name.rlike(p) | (workflow if c == "automated-checks" else F.lit(False)), F.lit(c)) for c, p in lex.EVIDENCE.items()]
    return paths.select("path", F.explode(F.array_compact(F.array(*hit))).alias("category")).select("category", "path")


def evidence_found(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(category, found, n_paths, first_path) of all categories, those without evidence too."""
    categories = spark.createDataFrame([(c,) for c in lex.EVIDENCE], "category string")
    per = found.groupBy("category").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return categories.join(per, "category", "left").select("category", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paths"), "first_path")


def catalogue() -> Column:
    """The model's twenty criteria as an array of struct<dimension, dim_ord, level, criterion>."""
    rows = [(d, i, level, c) for i, (d, cs) in enumerate(lex.MATURITY.items()) for level, c in enumerate(cs, 1)]
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("dimension", "dim_ord", "level", "criterion")))) for r in rows))


def maturity(answers: DataFrame) -> DataFrame:
    """(organisation, dimension, dim_ord, level, missing) from answers (organisation, dimension, criterion, met).

    A level holds if its criterion and all below are met: the level is one less than the first that is not. Only true
    counts; what is not answered or unknown is not met. An organisation appears once it has any answer.

    One aggregation without a join: an organisation's met criteria are the bits of one number. Joined with the answers,
    organisations looked small to the planner, as it does not see rows multiply, and went to the driver to be broadcast.
    """
    asked = [(d, c) for d, cs in lex.MATURITY.items() for c in cs]
    number = F.array_position(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("criterion")) for d, c in asked)), F.struct("dimension", "criterion"))
    bit = F.element_at(F.array(*(F.lit(1 << k).cast("bigint") for k in range(len(asked)))), F.nullif(number, F.lit(0)).cast("int"))
    # Unknown organisations are one row, but nobody's answers.
    met = F.bit_or(F.when(F.col("met") & F.col("organisation").isNotNull(), bit))
    rows = answers.groupBy("organisation").agg(F.coalesce(met, F.lit(0)).alias("met"))

    def reached(d: str, i: int, criteria: list[str]) -> Column:
        level, missing = F.lit(len(criteria)), F.lit("")
        for k in reversed(range(len(criteria))):
            has = F.col("met").bitwiseAND(F.lit(1 << asked.index((d, criteria[k]))).cast("bigint")) != 0
            level, missing = F.when(has, level).otherwise(F.lit(k)), F.when(has, missing).otherwise(F.lit(criteria[k]))
        return F.struct(F.lit(d).alias("dimension"), F.lit(i).alias("dim_ord"), level.alias("level"), missing.alias("missing"))

    levels = F.array(*(reached(d, i, list(cs)) for i, (d, cs) in enumerate(lex.MATURITY.items())))
    return rows.select("organisation", F.inline(levels))


def overall(levels: DataFrame) -> DataFrame:
    return levels.groupBy("organisation").agg(F.min("level").alias("overall"))


def trend(snapshots: DataFrame) -> DataFrame:
    """snapshots (series, timestamp, total) with the change since the one before in the same series."""
    w = Window.partitionBy("series").orderBy("timestamp")
    return snapshots.select("*", F.row_number().over(w).alias("audit"), (F.col("total") - F.lag("total").over(w)).alias("change"))
