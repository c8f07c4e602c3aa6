"""The pipeline's language stage keeps texts in the languages it learnt and lets others go."""

import corpus_pipeline
from prosegauge.llm import language_id


def test_stage_selects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and n_chars > 200")
    by = {r.lang: r.text for r in docs.where("lang is not null").orderBy("doc_id").collect()}
    mixed = " ".join(t[at : at + 40] for at in range(0, 800, 40) for t in by.values())
    others = [(10**6, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 60), (10**6 + 1, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 60), (10**6 + 2, "12 34 !? " * 60), (10**6 + 3, mixed)]
    more = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in others], docs.schema)
    both = docs.union(more)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, both, "").select("doc_id").collect()}
    assert not kept & {i for i, _ in others}
    assert len(kept) >= 0.99 * docs.count()
    one = {r.lang for r in language_id.keep_known(both, languages=["de"]).select("lang").distinct().collect()}
    assert one and len([x for x in one if x]) <= 2 and "de" in one
