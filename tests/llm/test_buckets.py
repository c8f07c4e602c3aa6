"""Near-duplicates: split buckets, and recall of links at and above the threshold."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from prosegauge.llm import minhash_dedup


def test_a_large_bucket_is_split_without_losing_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 900
    digests = rng.integers(-(2**62), 2**62, (n, 24))
    near = [(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b]
    for a, b in near:
        digests[b] = digests[a]
    rows = [(7, k, k, 100, digests[k].tolist(), [7]) for k in range(n)]
    schema = "band bigint, node bigint, component bigint, size bigint, digest array<bigint>, bands array<bigint>"
    named = spark.createDataFrame(rows, schema).repartition(4)
    want = {(a, b) for v in _groups(digests).values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for small, cell in ((10**9, 1), (1, 10**9), (1, 120)):
        monkeypatch.setattr(minhash_dedup, "SMALL", small)
        monkeypatch.setattr(minhash_dedup, "CELL", cell)
        got = [(r.a, r.b) for r in minhash_dedup.apart(named, 85).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_twenty_thousand_unlinked_members_of_one_bucket(spark):
    """Random digests with 40 planted near pairs: found whole, with sizes that rule others out, in bounded time."""
    rng = np.random.default_rng(5)
    n = 20_000
    digests, sizes = rng.integers(-(2**62), 2**62, (n, 24)), rng.integers(100, 1000, n)
    near = rng.permutation(n)[:80].reshape(-1, 2)
    for a, b in near:
        digests[b], sizes[b] = digests[a], sizes[a]
        digests[b, 3] ^= 0x0F0F
    flat = lambda x: x.tolist()
    frame = pd.DataFrame({"band": 7, "node": np.arange(n), "component": np.arange(n), "size": sizes, "digest": flat(digests), "bands": [[7]] * n})
    frame.loc[[int(b) for _, b in near[:5]], "component"] = [int(a) for a, _ in near[:5]]
    started = time.monotonic()
    named = spark.createDataFrame(frame, "band bigint, node bigint, component bigint, size bigint, digest array<bigint>, bands array<bigint>").repartition(8)
    got = sorted((r.a, r.b) for r in minhash_dedup.apart(named, 85).collect())
    assert time.monotonic() - started < 60
    assert got == sorted((int(min(p)), int(max(p))) for p in near[5:])


@pytest.mark.parametrize("similar", [85, 80])
def test_cells_decide_as_the_join_does(spark, similar):
    """Digests at all distances around the limit, ids of text, several bands: the condition in Spark and the one in
    Arrow batches agree."""
    rng = np.random.default_rng(similar)
    rows = []
    for k in range(120):
        digest, size = rng.integers(-(2**62), 2**62, 24), int(rng.integers(90, 110))
        for copy in range(3):
            other = digest.copy()
            slots = rng.permutation(384)[: minhash_dedup.different(similar) // 2 + int(rng.integers(-4, 5))]
            for s in slots:
                other[s // 16] ^= np.int64(1) << np.int64(4 * (s % 16))
            rows.append((7 + k % 2, f"n{k:03}-{copy}", f"n{k:03}-{copy % 2}", int(size * (1 + copy / 10)), other.tolist(), [5 + k % 3 * 2, 7 + k % 2]))
    named = spark.createDataFrame(rows, "band bigint, node string, component string, size bigint, digest array<bigint>, bands array<bigint>")
    results = []
    with pytest.MonkeyPatch.context() as patch:
        for small, cell in ((10**9, 1), (1, 10**9), (1, 50)):
            patch.setattr(minhash_dedup, "SMALL", small)
            patch.setattr(minhash_dedup, "CELL", cell)
            results.append(sorted((r.a, r.b) for r in minhash_dedup.apart(named, similar).collect()))
    assert results[0] == results[1] == results[2] and 0 < len(results[0]) < 240


def _groups(digests):
    out = {}
    for k, d in enumerate(digests):
        out.setdefault(d.tobytes(), []).append(k)
    return {k: v for k, v in out.items() if len(v) > 1}


@pytest.mark.parametrize("similar", [85, 80])
def test_recall_of_links_from_the_threshold_upwards(spark, similar):
    """Pairs of exactly known similarity: k of 5-word shingles replaced by cutting words from one end. Every pair at or
    above the threshold must be linked, none below it."""
    rng = random.Random(similar)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, linked = [], {}
    for k in range(150):
        n = rng.choice([40, 120, 400])
        base = [word() for _ in range(n + 4)]
        # A prefix of m shingles has similarity m / n.
        m = max(1, n * similar // 100 + rng.randrange(-2, 4))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: m + 4]))]
        linked[2 * k + 1] = 100 * m >= similar * n
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.dedup(df, similar=similar).collect()}
    found = {b: got[b] == b - 1 for b in linked}
    assert found == linked  # recall and precision 1.0 over the planted pairs
