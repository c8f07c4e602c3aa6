"""Small fixtures and brute force for the operators on single documents."""

import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from prosegauge.llm import bpe, decontamination, language_id, license_rules, license_scan, minhash_dedup, quality_classifier, quality_rules, token_tables
from prosegauge.llm.common import shared_path
from prosegauge.llm.html_text import extract, page_text

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", None, "<|endoftext|>x<|startoftext|>", "Don't I'LL 'Re 12a3", "İstanbul ΑΣ Σ", "é à", "a\x1cb\x1d!!", "日本語 🙂 مرحبا", "a" * 700, "!?" * 300, "ſ ﬁ K ß"]


def docs(spark, texts, extra=""):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, score double")


def test_quality_measures_against_brute_force(spark):
    texts = [None, "", "a b c a b c a", "x\nx\n\n y \ny", "A B!! " * 60, "w " * 3, "one two three four one two three", "#$%& |<> ok", "é ü " * 40]

    def brute(t):
        import re

        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        grams = {}
        for i in range(len(words) - 2):
            grams.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    for narrow in (quality_rules.NARROW, 2):  # 2: all longer texts take the wide keys
        rows = quality_rules.measure(docs(spark, texts), narrow=narrow).orderBy("doc_id").collect()
        assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [brute(t) for t in texts]


def test_policies_ablations_and_keep(spark):
    d = docs(spark, ["word and other thing " + " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)), "short", "a b c " * 40, None])
    rows = quality_rules.apply_policy(quality_rules.ledger(d))
    assert [r.kept for r in rows.orderBy("doc_id").collect()] == [True, False, False, False]
    by = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablations(rows).collect()}
    assert by["few_words"] == (2, 2, 3) and by["repeated_windows"] == (1, 1, 2)
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [0]
    assert quality_rules.keep(d.limit(0)).count() == 0
    assert quality_rules.failure_profile(rows).first().all_failed == 0


def test_license_scan(spark):
    assert len(license_rules.rules()) > 200
    d = docs(spark, ["Released under the MIT License. CC BY-NC 4.0; under the mit license", None, "", "Apache License, Version 2.0", "nothing", "© 2020 under the gnu gpl", "mit"])
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 1, 10, "cc-by-nc,mit")
    assert "cc-by-nc-4.0" in got[0].labels.split(",")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[3].base_labels == "apache-2" and got[3].score > 0 and "gpl" in got[5].labels
    assert got[4].labels == "" and got[6].labels == ""
    # CC BY within CC BY-NC is suppressed.
    assert "cc-by" not in got[0].labels.split(",")


def test_long_license_text(spark):
    d = docs(spark, ["under the mit license and cc by nc 4 0 " * 3000])
    r = license_scan.scan(d).first()
    assert r.n_base == 6000 and r.last_word == 10 * 2999 + 5 and r.labels == "cc-by-nc,cc-by-nc-4.0,mit"


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    texts = ODD + ["".join(chr(c) for c in rng.integers(32, 0x2FF, 30)) for _ in range(300)] + ["".join(rng.choice(list("abct"), 25)) for _ in range(300)]
    got = bpe.encode(docs(spark, texts), PATH, ids=True, decoded=True).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_cache_is_only_a_cache():
    small, large = bpe.Encoder(PATH, cache=3), bpe.Encoder(PATH, library=True)
    for t in ("one two three four five one two", "Ünï çödé " * 5):
        assert small.encode(t) == large.encode(t)


def test_usual_letters_split_like_the_library():
    encoder = bpe.Encoder(PATH)
    for c in [*map(chr, range(1, 0x180)), *map(chr, range(0x300, 0x305)), *map(chr, range(0x2010, 0x2023))]:
        text = f"a{c}b {c}1{c}"
        assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == encoder.rules.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_token_tables(spark):
    library = Tokenizer.from_file(PATH)
    texts = [t for t in ODD] + ["word " * 20000]
    d = docs(spark, texts).union(docs(spark, ["again"]))
    manifest = token_tables.write(d, PATH, shared_path(spark, "t"), 3)
    rows = token_tables.read(manifest).orderBy("doc_id", "start").collect()
    assert len(rows) == len(texts) + 1 and [r.doc_id for r in rows][:2] == [0, 0]
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id:
            ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    wanted = spark.createDataFrame([(4,), (12,), (99,), (-1,)], "doc_id bigint")
    found = {r.doc_id: r.ids for r in token_tables.lookup(wanted, manifest).collect()}
    assert set(found) == {4, 12} and found[4] == [*library.encode(texts[4], add_special_tokens=False).ids, 2]
    assert token_tables.read(token_tables.write(d.limit(0), PATH, shared_path(spark, "t"), 2)).count() == 0


def test_null_id_in_token_tables(spark):
    d = spark.createDataFrame([(None, "a b"), (-5, "c"), (3, "d")], "doc_id bigint, text string")
    rows = token_tables.read(token_tables.write(d, PATH, shared_path(spark, "t"), 2)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -5, 3]


def edit_distance_inside(p, w):
    prev = [0] * (len(w) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(w, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    items = [" ".join(word() for _ in range(14)) for _ in range(12)]
    texts = [None, ""]
    for k in range(60):
        s = list(items[k % 12])
        for _ in range(k % 7):
            s[rng.integers(len(s))] = "z"
        texts.append(" ".join(word() for _ in range(20)) + "\n" + "".join(s).upper() + ", " + " ".join(word() for _ in range(9)))
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "tiny")], "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.match(docs(spark, texts), bench).collect()}
    small = [decontamination.reduced(i) for i in items]
    for k, t in enumerate(texts):
        want = [i for i, p in enumerate(small) if t and edit_distance_inside(p, decontamination.reduced(t)) <= len(p) // decontamination.EDIT_SHARE]
        assert got[k] == want, k
    kept = decontamination.keep_clean(docs(spark, texts), bench)
    assert kept.columns == ["doc_id", "text", "kept", "score"] and kept.count() == sum(not v for v in got.values())
    assert decontamination.match(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    items = ["alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight", "red green blue cyan magenta yellow black"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.match(docs(spark, [f"x {items[2]} y {items[0]}", "none"]), bench).orderBy("doc_id").collect()
    assert [r.item_ids for r in got] == [[0, 2], []]


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 5, (3, 6)).astype(np.uint8)
    inputs, recurrent = rng.standard_normal((256, 6)).astype(np.float64), rng.standard_normal((2, 6))
    loss = lambda: float((language_id._run(data, inputs, recurrent) * weights).sum())
    weights = rng.standard_normal((6, 3, 2)).astype(np.float32)
    kept = []
    language_id._run(data, inputs, recurrent, kept)
    g_in, g_rec = language_id._back(data, recurrent, kept, weights)
    for array, grad, places in ((inputs, g_in, [(1, 0), (2, 3), (3, 5)]), (recurrent, g_rec, [(0, 0), (1, 3), (0, 5)])):
        for at in places:
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=0.02)


def test_language_and_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    got = quality_classifier.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.93 * len(got)


def test_models_without_training_rows(spark):
    d = docs(spark, [None, "", "12 34", "some words"]).selectExpr("*", "cast(null as string) as lang")
    assert [(r.lang_pred, r.score) for r in language_id.identify(d).collect()] == [("und", 0.0)] * 4
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, "de", "ein Text mit Wort"), (2, "en", "a text with words"), (5, "en", "1234")], "doc_id bigint, lang string, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(one).collect()}[5] == "und"


def test_html():
    page = "<head><title>T</title></head><h1>Head</h1><p>One <b>two</b>  three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div>in<span hidden>no</span>side</div>x &lt; 5<table><tr><th>Name<th>Qty<tr><td>apple<td>5<tr><td>kiwi fruit<td>12</table><pre> a\n  b</pre><script>n</script>end"
    assert page_text(page) == "Head\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n  3. x\n  4. y\n\ninside\nx < 5\n\nName        Qty\napple       5\nkiwi fruit  12\n\n a\n  b\n\nend"
    for bad in ("<" * 3000, "<a" * 3000, "<div>" * 3000 + "x", "<table>" * 500 + "x", "<!--" * 2000, "</p>" * 2000, "<a href='" * 999):
        assert isinstance(page_text(bad), str)
    assert page_text("<div>" * 3000 + "x").strip() == "x"


def test_html_keeps_all_words_of_plain_markup(spark):
    rng = np.random.default_rng(4)
    tags = "p div b i ul li h2 span td tr table section em".split()
    for _ in range(60):
        words = [f"w{k}" for k in range(40)]
        page = "".join(f"<{rng.choice(tags)}> {w} " + (f"</{rng.choice(tags)}>" if rng.random() < 0.6 else "") for w in words)
        assert sorted(w.lstrip("-") for w in page_text(page).split() if w != "-") == sorted(words)
    rows = extract(spark.createDataFrame([(1, None), (None, "<p>x"), (2, "")], "page_id bigint, html string")).collect()
    assert {(r.page_id, r.text) for r in rows} == {(1, ""), (None, "x"), (2, "")}


def test_super_minhash_against_the_literal_form():
    rng = np.random.default_rng(1)
    m = 40

    def literal(s):
        h = np.full(m, np.inf)
        for x in s.view(np.uint64):
            p = list(range(m))
            for j in range(m):
                with np.errstate(over="ignore"):
                    d = minhash_dedup.mix(np.array([x + np.uint64((2 * j + 1) * minhash_dedup._BASE % (1 << 64))]))
                v = j + float((d >> np.uint64(11))[0]) * 2.0**-53
                k = j + int((minhash_dedup.mix(d ^ np.uint64(minhash_dedup._BASE)) % np.uint64(m - j))[0])
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], v)
        return h

    for n in (1, 3, 30, 200):
        s = rng.integers(-(2**62), 2**62, n)
        assert (minhash_dedup.super_minhash([s, s[:1]], m)[0] == literal(s)).all()
