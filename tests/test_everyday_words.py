"""The acronym rule's everyday words do not depend on the corpus, unless a list or a table is given."""

from pyspark.sql import functions as F

from prosegauge.functions.everyday import everyday, forms, words_of_corpus
from prosegauge.functions.lexicon import EXPANSION_STOP_WORDS
from prosegauge.operators.acronyms import listed
from prosegauge.plans.audit import audit

DOCS = [(1, "The GNU tools and the ABOUT page go on."), (2, "PLEASE SAVE everything."), (3, "The AWS IAM service."), (4, "Plain words.")]


def details(spark, rows, **given):
    found = audit(spark.createDataFrame(rows, "doc bigint, text string"), only=["acronym-undefined"], **given)
    return sorted((r.doc, r.detail.split('"')[1]) for r in found.collect() if r.doc < 100)


def test_same_findings_alone_and_in_a_large_corpus(spark):
    alone = details(spark, DOCS)
    assert alone == [(1, "GNU"), (3, "AWS"), (3, "IAM")]
    # One hot text, which writes those acronyms in lower case, ten times the corpus.
    assert details(spark, DOCS + [(100 + k, "a gnu with aws and iam") for k in range(10 * len(DOCS))]) == alone


def test_lists_and_tables_give_the_same(spark):
    words = ["gnu", "please"]
    want = [(1, "ABOUT"), (2, "SAVE"), (3, "AWS"), (3, "IAM")]
    assert details(spark, DOCS, common=words) == want
    table = spark.createDataFrame([(w,) for w in words * 2], "word string")
    assert details(spark, DOCS, common=table) == want


def test_words_of_a_corpus_are_a_share_of_distinct_texts(spark):
    rows = [(k, f"some words here {k}") for k in range(10)] + [(100 + k, "a copy with rare terms") for k in range(50)]
    corpus = spark.createDataFrame([*rows, (999, None)], "doc bigint, text string")
    assert {r.word for r in words_of_corpus(corpus, 0.5).collect()} == {"some", "words", "here"}


def test_fixed_list():
    assert len(set(everyday())) == len(everyday()) and {"a", "please", "save", "the"} <= set(everyday())
    assert not {"it", "us", "gnu", "api"} & set(everyday())


def test_the_list_is_of_real_size_and_made_by_rule():
    assert len(everyday()) >= 5000
    assert forms("stop") >= {"stops", "stopped", "stopping", "stopper"} and forms("carry") >= {"carries", "carried", "carrying"} and forms("save") >= {"saved", "saving", "saves"}
    assert forms("push") >= {"pushes", "pushed"} and forms("it") == {"it"}
    assert not {"ids", "tvs", "uris"} & set(everyday())


SHOUTED = [
    "PLEASE STOP ADDING ORDERS TO THE LISTS.", "WARNING: DOORS OPENING QUICKLY.", "DO NOT ENTER WHEN LIGHTS ARE CHANGED.", "CHANGES WERE SAVED AND FILES REMOVED.",
    "SIGNS SHOWING PRICES MUST BE REMOVED TODAY.", "CALLERS WAITING LONGER THAN HOURS PAY LESS.", "THE HOTTEST DAYS OF THE YEARS", "PUSHING AND PULLING IS DANGEROUS",
]


def test_shouted_sentences_give_no_finding(spark):
    assert details(spark, list(enumerate(SHOUTED))) == []
    assert details(spark, [(1, "PLEASE STOP THE AWS IAM GNU SSO TTL.")]) != []


def test_a_word_is_in_the_list_or_not(spark):
    own = ["gnu", "it's", "a|b", "x;y", "naïve", ""]
    asked = [*everyday()[::7], *everyday()[:40], *(w + "x" for w in everyday()[::50]), "gnu", "b", "x", "|", ";", "naïve", ""]
    rows = spark.createDataFrame([(w,) for w in asked] + [(None,)], "w string")
    for words in ((), tuple(own), everyday(), (*own, *everyday())):
        want = {w for w in asked if w in {*words, *EXPANSION_STOP_WORDS} and w != ""}
        got = rows.where(listed(words)(F.col("w"))).collect()
        assert {r.w for r in got} == want
