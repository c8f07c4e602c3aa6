"""Ranked search, personal data and spelling variants against plain versions on small and odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from prosegauge.llm import personal_data, ranked_search, spelling_variants

LONG = "some words of a long text go on and on " * 60_000
#: Ids, texts and columns that clash with the operators' own.
TEXTS = [(None, "some words stand here"), (None, None), (1, None), (2, ""), (3, LONG), (3, LONG), (4, "12 ?! 34 été"), (5, "Words words WORDS colour color"), (5, "other words here"), (6, "?!")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in TEXTS]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return plain.selectExpr("*", "'x' as term", "1 as n", "'y' as word", "'z' as slice", "0 as score", "1 as rank", "'s' as spans", "'g' as gram", "'b' as bundle", "0 as item_id", "'f' as form")


# --- ranked search


def brute_search(docs, items, best=ranked_search.BEST):
    words = lambda t: re.findall(ranked_search.TERM, t.encode().lower().decode())
    held = [(d, Counter(words(t))) for d, t in docs if d is not None and t is not None]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def test_search_of_odd_rows(spark, docs):
    items = [(7, "other WORDS here"), (7, "colour"), (8, None), (None, "words"), (9, "?"), (10, "absent"), (11, "été 12")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in ranked_search.search(docs, bench).collect()]
    assert sorted(got) == brute_search(TEXTS, items) and got
    assert ranked_search.search(docs.limit(0), bench).count() == 0
    assert ranked_search.search(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size, bundle", [(64, 3), (4096, 256)])
def test_search_in_many_slices(spark, monkeypatch, size, bundle):
    """Few documents a slice make owners hand over and drop accumulators; ties are frequent."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(vocabulary[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    rows = [(k, text(rng.randint(1, 60))) for k in range(1500)] + [(k + 5000, "w1 w2 w3 w200") for k in range(300)]
    items = [(k, text(12)) for k in range(25)]
    monkeypatch.setattr(ranked_search, "SLICE", size)
    monkeypatch.setattr(ranked_search, "BUNDLE", bundle)
    monkeypatch.setattr(ranked_search, "BROADCAST_PAIRS", 0 if size == 64 else 10**6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted(tuple(r) for r in ranked_search.search(df, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == brute_search(rows, items)


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), m.end(), k))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "B9", "@", "@x.de", ".", "..", "_", "%", "-", " ", "+", "+4", "(0)", "1", "22", "256", "1.2.3.4", "007", "4111 1111 1111 1111", "4111-1111", "é", "١", "\n", "٣٣", "+1 (017) 555-7713", "x@y"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal_data.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["9" * 300_000, "1." * 150_000, "a@" * 150_000, "+" * 300_000, "+1" + " " * 300_000, "a" * 300_000, "1 " * 150_000, "ab at " * 50_000, "A1B2C3D4" * 40_000, "(1" * 150_000, "a.b" * 100_000 + "@"])
def test_spans_of_hostile_texts(text):
    began = time.time()
    personal_data.base_spans(text)
    personal_data.candidates(text)
    assert time.time() - began < 5


def test_trees_learn_and_thresholds_are_precise():
    x, y, kinds = personal_data.examples(["some plain words of a text stand here for a while"], 4000)
    apart = np.arange(len(x)) % 4 == 0
    trees = personal_data.fit_trees(x[~apart], y[~apart])
    slope, offset = personal_data._calibrate(trees.score(x[apart]), y[apart])
    p = personal_data.Model(trees, slope, offset, []).probability(x[apart])
    assert ((p > 0.5) == (y[apart] > 0)).mean() > 0.95
    # Probabilities say how often they are right.
    for low, high in ((0.0, 0.2), (0.8, 1.01)):
        band = (p >= low) & (p < high)
        assert abs(p[band].mean() - y[apart][band].mean()) < 0.06
    assert personal_data._threshold(np.array([0.9, 0.8, 0.7]), np.array([1.0, 0.0, 0.0])) == pytest.approx(0.85)
    assert personal_data._threshold(np.zeros(0), np.zeros(0)) == 2.0


def test_personal_data_of_rows(spark, docs):
    odd = spark.createDataFrame([(20, "mail a.b@c.de or call +1 (017) 555-7713 now"), (21, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" und'), (22, "card 4845 1681 1440 7321 phone (030) 555-7713 on 2024-05-17"), (23, "write to john.doe (at) example.org")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    rows = personal_data.find(both).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([i for i, _ in TEXTS] + [20, 21, 22, 23], key=str)
    by = {r.doc_id: r for r in rows}
    assert (by[20].n_email, by[20].n_phone) == (1, 1) and by[20].spans.startswith("email:5:13,phone:22:39")
    assert by[20].base_sha256 == hashlib.sha256(b"email:5:13,phone:22:39").hexdigest()
    assert by[21].spans == "secret:9:49" and by[21].n_added == 1
    assert by[22].spans == "card:5:24,phone:31:45" and by[22].n_card + by[22].n_phone in (0, 1)
    assert by[23].spans == "email:9:34"
    assert by[2].spans == by[1].spans == by[3].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data.find(docs.limit(0)).count() == 0


def test_overlapping_candidates():
    chances = np.array([0.9, 0.95, 0.6, 0.99])
    spans = [(0, 10, 3), (5, 15, 2), (20, 30, 6), (40, 50, 0)]
    kept = personal_data.select(spans, [(45, 48, 1)], chances, [0.5] * 7)
    assert kept == [(5, 15, 2), (20, 30, 6), (45, 48, 1)]
    assert personal_data.redact("a 1.2.3.4 b", [(2, 9, 1)]) == "a [ip] b"


# --- spelling variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.encode().lower().decode()
            if d is not None and (h := zlib.crc32(f"{d}:{word}".encode())) % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                n[word] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (top if top and n[top] >= 2 * n[w] else None, n[w], len(near))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted((w, f, root(w), k, c, n[f] if f else None) for w, (f, k, c) in out.items())


def test_variants_equal_brute_force(spark, docs):
    rng = random.Random(11)
    stems = ["colour", "center", "traveller", "aaaaaa", "ababab", "straße", "ÉTÉÉTÉ", "organise", "éèêëéè"]
    rows = list(TEXTS)
    for k in range(400):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems) if rng.random() < 0.6 else stems[0]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("obÉ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k + 100, " ".join(words)))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(TEXTS) :], "doc_id bigint, text string"))
    got = sorted(tuple(r) for r in spelling_variants.variants(frame.withColumn("n", frame.doc_id)).collect())
    assert got == brute_variants(rows) and sum(r[4] for r in got) > 500 and any(r[1] and r[2] != r[1] for r in got)
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_pivots_are_the_cheapest_two_apart():
    rng = random.Random(2)
    for _ in range(2000):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        prefix = [(p, rng.randint(1, 9)) for p in places]
        a, b = (prefix[k] for k in spelling_variants.pivots(prefix))
        pairs = [x[1] + y[1] for x in prefix for y in prefix if y[0] - x[0] >= 2]
        assert b[0] - a[0] >= 2 and a[1] + b[1] == min(pairs)
