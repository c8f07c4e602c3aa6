"""Sentences of tidy texts, which a task measures together, against those that Spark's patterns find; and acronyms in
texts that shout."""

import pyarrow as pa
from pyspark.sql import functions as F

from prosegauge.operators import structure
from prosegauge.operators.sentences import measured, settled
from prosegauge.operators.structure import parsed
from prosegauge.plans.audit import audit

PLACES = ["Dr. No", "e.g. it", "the end. So", "st. Then", "St. Mary", "a. b", "A. The", "inc.) Or", "no.” We", "ón. X", "approx. 5", "a.pprox. 6", "e.t.c. Now", "why?! Go", "x.* Y", ". .", "!! ?", "(Dr.) No", "U.S. He", "wow.' 'Yes", "npm. iOS", "...\nSo", "’. Z", "d.R.\nA"]


def test_sentences_are_those_of_the_patterns(spark):
    texts = [f"We go {p} on." for p in PLACES] + PLACES + [" ".join(PLACES), "\n".join(PLACES), "x", "x y\nz."]
    rows = parsed(spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").coalesce(1))
    assert rows.where("sentences is null").count() == 0
    block = F.get("blocks", F.lit(0))
    for r in rows.select(block.text.alias("text"), settled(F.col("sentences"), F.col("doubts")).alias("a"), measured(block).alias("b")).collect():
        assert r.a == r.b, r


def test_untidy_texts_are_left_to_patterns():
    texts = pa.array(["tidy text", "two  blanks", " first", "last\n", "a\n\nb", "a\n b", "a\tb", "a b", "", None, "# Head"])
    (piece,) = structure.in_pieces(texts)
    assert [x["sentences"] is not None for x in piece.to_pylist()] == [True] + [False] * 10


def test_findings_of_a_text_that_shouts(spark):
    text = "THE!! END!! OF!! IT!! QXY, is near a QXZ. " + "Plain words stand here now and then. " * 3 + "Chapter II, XIV, and QQZ (Quick Quiet Zone) or\nVWX then (not) ZZY."
    found = audit(spark.createDataFrame([(1, text)], "doc bigint, text string"), only=["acronym-undefined"]).collect()
    assert {(r.line, r.detail) for r in found} == {(1, 'define acronym "QXZ" on first use'), (2, 'define acronym "VWX" on first use'), (2, 'define acronym "ZZY" on first use')}
