"""The near-dedup stage of the pipeline against brute force at its own threshold."""

import random

import corpus_pipeline
import pytest
from prosegauge.llm import minhash_dedup


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_groups(rows, similar):
    """Ids that are the least of their group when all pairs are compared."""
    sets, top = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i for i in top if root(i) == i}


def test_stage_against_brute_force(spark, sf):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(40):
        base = [word() for _ in range(204)]
        rows.append((2 * k, " ".join(base)))
        for _ in range(rng.randrange(3, 6)):
            base[rng.randrange(len(base))] = word()
        rows.append((2 * k + 1, " ".join(base)))
    want = first_of_groups(rows, 80)
    assert want != first_of_groups(rows, 85)  # pairs between the two thresholds exist
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, sf).collect()} == want


def test_bands_and_digests_follow_the_threshold():
    assert (minhash_dedup.bands_of(85), minhash_dedup.different(85)) == (28, 88)
    for similar in (80, 85, 95):
        assert (1 - (similar / 100) ** minhash_dedup.ROWS) ** minhash_dedup.bands_of(similar) <= minhash_dedup.MISSED
    assert minhash_dedup.different(80) > minhash_dedup.different(85)
    with pytest.raises(ValueError):
        minhash_dedup.bands_of(50)
