import pytest
from pyspark.sql import functions as F

from prosegauge.functions.text import config_hash
from prosegauge.operators.acronyms import acronym_undefined
from prosegauge.operators.sentences import marked, n_fewest, n_most
from prosegauge.operators.structure import Parsed
from prosegauge.plans.audit import OPERATORS, audit, files, findings, totals

DOC = """---
title: x
---
# Head. Two sentences here.

### Skipped level.

We shall utilise this in order to win. It is not
unlike "shall" and `shall` each and every day. See the report Null and Void today.

| a | |
|---|---|
| 1 | 2 |

See [here](http://x.y/z) and [ok text][ref] and ![](img.png) and [click here][ref] [nope].

[ref]: http://e.f

Setext head
===========

```
shall shall
```

- first item is first. Then second and third.

<a href="q">read
more</a> <img src="p.png"> <img src="z" alt="">
##### Deep
"""


def lines(df):
    return sorted((r.line, r.detail) for r in df.collect())


def run(spark, rule, text):
    return lines(audit(spark.createDataFrame([(1, text)], "doc bigint, text string"), only=[rule]))


def test_hash_of_thresholds():
    assert config_hash() == "ca6f9562"


def test_every_rule_in_one_document(spark):
    corpus = spark.createDataFrame([(1, DOC)], "doc bigint, text string")
    rows = audit(corpus).collect()
    got = {rule: sorted((r.line, r.detail) for r in rows if r.rule == rule) for rule in OPERATORS}
    assert got["legalese"] == [(8, 'banned term "shall"')]
    assert got["complex-word"] == [(8, '"utilise" where "use" would do')]
    assert got["double-negative"] == [(8, '"not\nunlike" makes the reader unpick two negatives')]
    assert got["wordy-phrase"] == [(8, '"in order to" says what "to" says')]
    assert got["doublet"] == [(9, 'redundant phrase "each and every"; consider "each"')]
    assert got["prose-enumeration"] == [(26, "enumeration ranks 1, 2, 3 in prose; consider a list")]
    assert got["heading-depth"] == [(30, "heading level 5 (limit 4)")]
    assert got["heading-skip"] == [(6, "heading jumps from level 1 to level 3"), (30, "heading jumps from level 1 to level 5")]
    assert got["heading-style"] == [(4, "2 sentences in heading"), (6, "heading ends with a full stop")]
    assert got["table-header"] == [(11, "table header has an empty column name")]
    assert got["link-text"] == [
        (15, 'link text "click here" describes no destination (ref)'),
        (15, 'link text "here" describes no destination (http://x.y/z)'),
        (28, 'link text "read more" describes no destination (q)'),
    ]
    assert got["image-alt"] == [(15, "image has no alternative text (img.png)"), (29, "image has no alternative text (p.png)")]


@pytest.mark.parametrize(
    ("text", "most", "fewest"),
    [
        ("One. Two.", 2, 2),
        ("Dr. Smith left. He ran.", 2, 2),
        ("See J. Smith there.", 1, 1),
        ("See J. the results.", 2, 1),
        ("Packs etc. The end.", 2, 2),
        ("Packs etc. Customers pay.", 2, 1),
        ("Fig. A shows it.", 1, 1),
        ("The U.S. policy holds.", 1, 1),
        ("The U.S. Department paid.", 2, 1),
        ("e.g. iOS and more.", 2, 1),
        ('He said "no." Then left!', 2, 2),
    ],
)
def test_two_readings(spark, text, most, fewest):
    blocks = spark.createDataFrame([(1, text)], "doc bigint, text string")
    r = blocks.select(marked(F.col("text")).alias("m")).select(n_most(F.col("m")).alias("m"), n_fewest(F.col("m")).alias("f")).first()
    assert (r.m, r.f) == (most, fewest)


def test_sentence_limits(spark):
    word = " ".join(["word"] * 30)
    assert run(spark, "sentence-length", f"{word}.") == []
    assert run(spark, "sentence-length", f"Ok.\n\n{word} more.") == [(3, "31 words (limit 30)")]
    assert run(spark, "paragraph-length", "A b. " * 5) == []
    assert run(spark, "paragraph-length", "A b. " * 6) == [(1, "6 sentences (limit 5)")]
    long = " ".join(["w"] * 21) + ". "
    assert run(spark, "sentence-average", long * 9) == []
    assert run(spark, "sentence-average", long * 10) == [(1, "average 21.0 words across 10 sentences (limit 20)")]
    assert run(spark, "sentence-average", (" ".join(["w"] * 20) + ". ") * 10) == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_are_equal(spark, end):
    text = "﻿One two.\n\n  We shall go.\n\n# A\n\nHereby done.".replace("\n", end)
    assert run(spark, "legalese", text) == [(3, 'banned term "shall"'), (7, 'banned term "hereby"')]


def test_plain_path_and_line_path_agree(spark):
    plain = "One two. Three\nfour.\n\n\n  We shall go on.\nLast line here.\n\nEnd."
    a = Parsed(spark.createDataFrame([(1, plain)], "doc bigint, text string")).blocks.collect()
    marked = Parsed(spark.createDataFrame([(1, plain + "\n\n# H")], "doc bigint, text string")).blocks.collect()
    assert sorted((r.line, r.text) for r in a) == sorted((r.line, r.text) for r in marked)


def test_filler(spark):
    assert run(spark, "filler-opening", "Sure, it works.") == [(1, 'opens with "sure" instead of the answer')]
    assert run(spark, "filler-opening", "Surely it works.") == []
    assert run(spark, "filler-opening", "Certainly not.") == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("We use CSS here.", ["CSS"]),
        ("Style sheets (CSS) help. CSS is used.", ["CSS"]),
        ("Cascading Style Sheets (CSS) help. CSS is used.", []),
        ("CSS (Cascading Style Sheets) helps.", []),
        ("See Chapter IV and the PDF.", []),
        ("The CI job.", ["CI"]),
        ("PLEASE SAVE everything.", []),
        ("The AWS IAM service.", ["AWS", "IAM"]),
    ],
)
def test_acronyms(spark, text, found):
    corpus = spark.createDataFrame([(1, text)], "doc bigint, text string")
    common = spark.createDataFrame([("please",), ("save",)], "word string")
    got = [r.detail.split('"')[1] for r in acronym_undefined(corpus, common).orderBy("ord").collect()]
    assert got == found


def test_project_acronyms_are_known(spark):
    corpus = spark.createDataFrame([(1, "We use CSS.")], "doc bigint, text string")
    common = spark.createDataFrame([], "word string")
    assert acronym_undefined(corpus, common, ["CSS"]).count() == 0


def test_clean_null_and_empty_documents_stay_listed(spark):
    corpus = spark.createDataFrame([(1, "We shall."), (2, None), (3, ""), (4, "Fine.")], "doc bigint, text string")
    found = audit(corpus)
    assert {(r.doc, r.n_violations) for r in files(corpus, found).collect()} == {(1, 1), (2, 0), (3, 0), (4, 0)}
    assert [(r.rule, r.n) for r in totals(found).collect()] == [("legalese", 1)]
    rows = {r.path: [v.detail for v in r.violations] for r in findings(corpus, found).collect()}
    assert rows == {1: ['banned term "shall"'], 2: [], 3: [], 4: []}


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "doc bigint, text string")
    assert audit(corpus).count() == 0


def test_complex_words_are_whole_runs_of_letters_and_apostrophes(spark):
    texts = {"We utilise's it.": 0, "We utilise2 it.": 1, "We 'utilise it.": 0, "We utilise_ it.": 1, "We Utilise, it.": 1, "We utilised it.": 0, 'The word "utilise" is long.': 0}
    rows = audit(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), only=["complex-word"]).collect()
    assert [sum(r.doc == k for r in rows) for k in range(len(texts))] == list(texts.values())
