"""Phrases from tables: the shipped list gives the audit's findings, a large one with overlaps equals brute force."""

import random
import re

import pytest
from prosegauge.functions import lexicon as lex
from prosegauge.operators import phrases as ph
from prosegauge.plans.audit import audit

TEXTS = [
    "We do it in order to win.\nAt this point in time, in spite of the fact that\nit rains, IN  ORDER\nTO go.",
    "Say \"in order to\" or `in order to ` and 'in order to go'.",
    "It's in-order to, xin order to, in order to2, (in order to).",
    None,
    "",
    "A # of the fact.\n\nFor the purpose of it, due to the fact that we may.",
]


def lexicon(spark, rows):
    return spark.createDataFrame(rows, "phrase string, rank int, detail string")


def test_the_shipped_list_gives_the_same(spark):
    corpus = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[0])], "doc int, text string")
    rows = [(p, k, f'"{p}" says what "{lean}" says') for k, (p, lean) in enumerate(lex.WORDY.items())]
    got = sorted((str(r.doc), r.line, r.detail) for r in ph.phrases(corpus, lexicon(spark, rows), "wordy-phrase").collect())
    want = sorted((str(r.doc), r.line, r.detail) for r in audit(corpus, only=["wordy-phrase"]).collect())
    assert got == want and len(got) >= 12


def brute(text, entries):
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9_]+", text)]
    norm = lambda s: re.sub(r"\s+", " ", s.lower())
    by = {}
    for p, rank, detail in entries:
        by.setdefault(norm(p), (rank, p, detail))
    sizes = {len(p.split(" ")) for p in by}
    found = [(-n, by[key][0], i, by[key][2]) for i in range(len(words)) for n in sizes if i + n <= len(words) and (key := norm(text[words[i][1] : words[i + n - 1][2]])) in by]
    taken, kept = set(), []
    for n, _, i, detail in sorted(found):
        if not taken & set(range(i, i - n)):
            taken |= set(range(i, i - n))
            kept.append((i, detail))
    return [d for _, d in sorted(kept)]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_a_hundred_thousand_phrases_with_overlaps(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ph, "BROADCAST_PHRASES", broadcast)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    entries, seen = [], set()
    while len(entries) < 100_000:
        p = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5])))
        if p not in seen:
            seen.add(p)
            entries.append((p, len(entries), f"<{p}>"))
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for r in ph.phrases(corpus, lexicon(spark, entries), "own").orderBy("doc", "ord").collect():
        got.setdefault(r.doc, []).append(r.detail)
    assert {k: brute(t, entries) for k, t in enumerate(texts)} == {k: got.get(k, []) for k in range(len(texts))}


def test_odd_tables(spark):
    corpus = spark.createDataFrame([(1, "One two three.")], "doc int, text string")
    assert ph.phrases(corpus, lexicon(spark, []), "own").count() == 0
    rows = [(None, 1, "a"), ("?!", 2, "b"), ("one  TWO", 3, "c"), ("One two", 1, "d"), ("two three", 0, "e"), ("", 0, "f")]
    assert [(r.line, r.detail) for r in ph.phrases(corpus, lexicon(spark, rows), "own").collect()] == [(1, "e")]
    assert ph.phrases(corpus.limit(0), lexicon(spark, rows), "own").count() == 0
