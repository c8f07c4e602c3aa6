"""Rule marks of the current policy: numbers in clean text are no marks."""

import duckdb
import pytest
from prosegauge.llm import queries, quality_rules

WORDS = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))


def test_clean_text_with_numbers_is_kept(spark):
    texts = [WORDS, WORDS + " 4111 1111 1111 1111 and 2024-03-05 or 030 1234567", WORDS + " " + ", ".join("?!" for _ in range(20)), WORDS + " " + "0123456789 " * 3 + "? ! ; : . , " * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = quality_rules.ledger(docs)
    kept = lambda *version: [r.kept for r in quality_rules.apply_policy(rows, *version).orderBy("doc_id").collect()]
    assert kept("v1") == [True, False, False, False]
    assert kept() == [True, True, False, False]
    assert [r.doc_id for r in quality_rules.keep(docs).orderBy("doc_id").collect()] == [0, 1]
    by = {r.rule: r.n_failed for r in quality_rules.ablations(rows).collect()}
    assert by["marks_without_digits"] == 2


def test_op9_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.op9_quality_rules(spark, sf)
    want = con.sql(queries.oracle_sql()["op9_quality_rules"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    with pytest.raises(ValueError):
        quality_rules.sql("v2")
