"""Decontamination: short items match whole words exactly; the classifier's sample stays bounded."""

from prosegauge.llm import decontamination, quality_classifier


def test_short_items_match_whole_words_exactly(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "..."), (3, "cat nap"), (None, "what is 2 2"), (4, None)], "item_id bigint, text string")
    texts = ["He said: WHAT is 2 + 2", "whatis 2 2", "somewhat is 2 2", "what is 2 22", "a concat nap", "cat, nap!", "cat\nnaps", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as item_ids", "'x' as found")
    got = {r.doc_id: (r.item_ids, r.distance) for r in decontamination.match(docs, bench).collect()}
    assert got == {0: ([1], 0), 1: ([], None), 2: ([], None), 3: ([], None), 4: ([], None), 5: ([3], 0), 6: ([], None), 7: ([], None), 8: ([], None)}
    # With edits allowed for short items too, one edit in 25 characters is none for these.
    assert decontamination.match(docs, bench, shortest=0).where("contaminated").count() >= 2
    assert decontamination.keep_clean(docs, bench).columns == docs.columns


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda good, bad, share: seen.append((len(good), len(bad))))
    docs = spark.createDataFrame([(k % 7, f"text {k}") for k in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id bigint, quality int, toxic int")
    quality_classifier.fit(docs, labels)
    assert sum(seen[0]) <= 7
