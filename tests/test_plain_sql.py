"""SQL table functions over plain text: no Python in the plan, the same rows as the DataFrame form."""

import pytest
from prosegauge.functions import plain_sql
from prosegauge.plans.audit import audit
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def registered(spark):
    plain_sql.register(spark)


def test_sentences(spark, registered):
    text = "We met Dr. Smith. It was U.S. law.\nThen?  Yes.\n\n  First it's \"done.\" Next."
    spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "id int, text string").createOrReplaceTempView("sentence_docs")
    df = spark.sql("SELECT id, s.* FROM sentence_docs, LATERAL text_sentences(text) s")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    want = [
        (1, 1, 1, "We met Dr. Smith."), (1, 1, 1, "It was U.S. law."), (1, 1, 2, "Then?"), (1, 1, 2, "Yes."),
        (1, 2, 4, "First it's \"done.\""), (1, 2, 4, "Next."), (4, 1, 1, "x"),
    ]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_findings_equal_the_audit(spark, registered, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    more = spark.createDataFrame([(-1, "We shall utilise the GNU tools in order to go. It is not unlike 'shall'."), (-2, None), (-3, "Each and every NASA (National Aeronautics and Space Administration) man.")], "doc bigint, text string")
    every = docs.unionByName(more)
    every.createOrReplaceTempView("finding_docs")
    df = spark.sql("SELECT doc, s.rule, s.line, s.detail FROM finding_docs, LATERAL text_findings(text) s")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    want = audit(every, only=["sentence-length", "paragraph-length", "sentence-average", "legalese", "complex-word", "double-negative", "wordy-phrase", "doublet", "filler-opening", "prose-enumeration", "acronym-undefined"])
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(map(tuple, want.select("doc", "rule", "line", "detail").collect())) and len(got) > 50


def test_operators_and_literals_become_sql():
    class Fake:
        def __init__(self, text):
            self._jc = self
            self.text = text

        def node(self):
            return self

        def sql(self):
            return self.text

    assert plain_sql.sql_of(Fake(r"and(=(x, 'in(\'a'), !(in(y, '=(')))")) == r"`and`(`=`(x, 'in(\'a'), `!`(`in`(y, '=(')))"
    assert plain_sql.sql_of(Fake("min(x) + join(`a`(y))")) == "min(x) + join(`a`(y))"
