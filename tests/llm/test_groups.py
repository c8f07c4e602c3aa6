"""Near-duplicates, WARC and the pipeline against brute force."""

import hashlib
import io
import random

import corpus_pipeline
from prosegauge.llm import minhash_dedup, warc
from prosegauge.llm.common import shared_path


def shingles(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, similar=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    top = {i: i for i, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def test_dedup_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "x")]
    base = [[word() for _ in range(150)] for _ in range(6)]
    for k in range(160):
        w = list(base[k % 6])
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.dedup(df).collect()}
    assert got == brute(rows)


def test_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "other words here"), (2, "OTHER words here"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, False)], key=str)
    assert minhash_dedup.dedup(df.limit(0)).count() == 0
    kept = minhash_dedup.keep_one(df)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, None]


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TASK_EDGES", 20)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 300) if k % 50 != 49] + [(1000, k) for k in range(1001, 1100)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)
    got = {(r.node, r.component) for r in minhash_dedup.components(df).collect()}
    assert got == {(k, k // 50 * 50) for k in range(300)} | {(k, 1000) for k in range(1000, 1100)}


def test_warc_round_trip(spark):
    same, odd = "é" * 600, "x\r\n\r\nWARC/1.0\r\n\x1e" + "y" * 1200
    rows = [(1, "http://a b/", same), (2, None, same), (3, "http://c", same), (4, "http://d", None), (5, "http://e", ""), (6, "u\nv", "short"), (7, "http://f", "short"), (8, "", odd), (9, "http://g", odd), (None, "http://h", odd)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), 7: ("response", None), 8: ("revisit", 9), 9: ("response", None), None: ("revisit", 9),
    }
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_both_arc_versions(spark):
    pages = spark.createDataFrame([(1, "http://a", "one\ntwo"), (2, "http://b", "three")], "page_id bigint, url string, html string")
    for version in (1, 2):
        path = shared_path(spark, "arc")
        warc.write_arc(pages, path, version)
        assert {(r.page_id, r.url, r.body.decode(), r.date) for r in warc.read_arc(spark, path).collect()} == {(1, "http://a", "one\ntwo", "2024-01-01T00:00:00Z"), (2, "http://b", "three", "2024-01-01T00:00:00Z")}
    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    head = f"filedesc://x 0.0.0.0 20200101000000 text/plain {len(t := '1 0 x' + chr(10) + warc.ARC_FIELDS[1] + chr(10))}\n{t}\n"
    record = f"http://a 0.0.0.0 20200102030405 text/html {len(block)}\n".encode() + block + b"\n"
    assert [b for _, b in warc.arc_records(io.BytesIO(head.encode() + record * 2))] == [block, block]


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_dedup", "decontamination", "bpe"]
    from prosegauge.llm import decontamination, language_id, quality_rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(list(kept)))
    known = {r.doc_id for r in language_id.keep_known(left).collect()}
    rows = [(r.doc_id, r.text) for r in left.collect() if r.doc_id in known]
    first = {i for i, _, _, keep in brute(rows, 80) if keep}  # stages without a contract of their own link at 0.8
    bench = [decontamination.reduced(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, t in rows if i in first and not any(b in decontamination.reduced(t) for b in bench if len(b) >= decontamination.SHORTEST)}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r.doc_id for r in got.collect()} == clean


def test_stages_with_nulls_and_extra_columns(spark, sf):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 2), (2, "ab " * 70, None, 3)], "doc_id bigint, text string, lang string, kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
