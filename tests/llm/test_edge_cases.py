"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import numpy as np
import public_tokenizers
import pytest
from prosegauge.llm import bpe, decontamination, language_id, license_scan, minhash_dedup, quality_classifier, quality_rules, token_tables

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "under the mit license some words of a long text go on and on " * 40_000
TEXTS = [(None, "some words stand here"), (None, None), (1, None), (1, None), (2, ""), (3, LONG), (3, LONG), (4, "12 ?! 34"), (5, "ein Text mit Worten"), (5, "other words here")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i == 5 else "en") for i, t in TEXTS]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # Columns with the names of the operators' own.
    return plain.selectExpr("*", "'x' as score", "1 as n_words", "'y' as words", "'z' as row", "2 as kept", "array(1) as found", "0 as n_tokens", "'k' as node", "'b' as band", "'s' as set_key")


def operators(spark):
    bench = spark.createDataFrame([(7, "some words of a long text go on and on under the mit license"), (7, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    return {
        "op1": license_scan.scan,
        "op2": language_id.identify,
        "op3": lambda d: bpe.encode(d, PATH),
        "op4": minhash_dedup.dedup,
        "op5": lambda d: decontamination.match(d, bench),
        "op8": lambda d: quality_classifier.classify(d, labels),
        "op9": lambda d: quality_rules.apply_policy(quality_rules.ledger(d)),
        "op10": lambda d: token_tables.round_trip(spark, d, PATH).drop("shard", "start"),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op8", "op9", "op10"])
def test_odd_rows(spark, docs, name):
    apply = operators(spark)[name]
    rows = apply(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in TEXTS), key=str)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(tuple(r))
    assert by[1][0] == by[1][1] and by[3][0] == by[3][1]  # repeated rows, repeated results
    assert apply(docs.limit(0)).count() == 0
    again = apply(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_results_of_odd_rows(spark, docs):
    ops = operators(spark)
    at = lambda name, i: next(r for r in ops[name](docs.where(docs.doc_id == i)).collect())
    assert at("op1", 3).n_base == 40_000 and at("op1", 2).labels == ""
    assert at("op5", 3).item_ids == [7] and not at("op5", 1).contaminated
    assert at("op3", 1).n_tokens == 0 and at("op10", 1).n_tokens == 1
    assert at("op9", 3).n_words == len(LONG.split()) and at("op9", 1).n_words == 0
    assert at("op4", 1).component_id == 1 and at("op4", 1).n_shingles == 0


def area(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_rows_of_both_classifiers(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) >= 0.85
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    per = {}
    for r in rows:
        per.setdefault(r.lang, []).append(r.lang == r.lang_pred)
    assert all(np.mean(v) >= 0.9 for v in per.values()) and len(per) == 4


def test_language_against_brute_force(spark):
    """The batched network over whole texts against one position at a time."""
    text = "the quick brown fox jumps over the lazy dog and goes home " * 4
    model = language_id.train([text.encode()[:96], "der schnelle braune Fuchs springt nach Hause und schläft ".encode()], ["en", "de"])
    whole = text.encode()
    total = np.zeros(2)
    for at in range(0, len(whole), language_id.STEPS):
        piece = whole[at : at + language_id.STEPS]
        padded = np.frombuffer(piece + bytes(language_id.STEPS - len(piece)), np.uint8)[None]
        p = language_id.position_probabilities(model, padded)[: len(piece), 0]
        total += sum(x for x, b in zip(p, piece) if model.seen[b])
    assert language_id.document_scores(model, [b"", whole])[1] == pytest.approx(total / len(whole), abs=1e-5)
