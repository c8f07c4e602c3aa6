"""Maturity of many organisations: one aggregation, nothing that grows with them goes through the driver."""

from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.operators import governance


def answers(spark, n):
    each = spark.range(n).select(F.col("id").alias("organisation"), F.explode(governance.catalogue()).alias("m"))
    return each.select("organisation", "m.dimension", "m.criterion", (F.col("organisation") >= F.col("m.level")).alias("met"))


def test_no_join_whatever_the_planner_thinks(spark):
    levels = governance.maturity(answers(spark, 1000))
    for rows in (levels, governance.overall(levels)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
    assert {(r.organisation, r.overall) for r in governance.overall(levels).collect()} == {(k, min(k, 4)) for k in range(1000)}


def test_repeated_unknown_and_missing_answers(spark):
    first, second = lex.MATURITY["governance"][:2]
    rows = [
        ("a", "governance", first, False), ("a", "governance", first, True), ("a", "governance", second, None),
        ("b", "odd", first, True), ("b", None, None, True), (None, "governance", first, True), ("c", "governance", second, True),
    ]
    got = governance.maturity(spark.createDataFrame(rows, "organisation string, dimension string, criterion string, met boolean")).where("dimension = 'governance'")
    assert {(r.organisation, r.dim_ord, r.level, r.missing) for r in got.collect()} == {("a", 0, 1, second), ("b", 0, 0, first), (None, 0, 0, first), ("c", 0, 0, first)}
    assert got.columns == ["organisation", "dimension", "dim_ord", "level", "missing"]
