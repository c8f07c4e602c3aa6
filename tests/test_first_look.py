"""Costs of an audit: one look tells which plain texts may hold a phrase, and results stay as they were."""

from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.functions.text import words_in
from prosegauge.operators.acronyms import CANDIDATE, SPELT, token_of
from prosegauge.operators.sentences import marked, sentence_words
from prosegauge.operators.structure import parsed
from prosegauge.plans.audit import audit

ALL = [*lex.LEGALESE, *lex.DOUBLE_NEGATIVES, *lex.WORDY, *lex.DOUBLETS, *lex.COMPLEX_WORDS]


def corpus(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc bigint, text string")


def test_only_texts_with_a_phrase_are_searched(spark):
    texts = ["A clean text.", None, "", "We ship the box.\n\nAnd more."]
    assert [r.phrases for r in parsed(corpus(spark, texts)).orderBy("doc").collect()] == [False] * 4


def test_every_phrase_is_found_as_before(spark):
    shapes = ["We {} it.", "{}", "\u00e9{}\u00e9 on", "One\u2003{}\nmore", "Mark it (<i></i>{}) so."]
    texts = [s.format(w.replace(" ", gap)) for p in ALL for w in (p, p.upper()) for gap in (" ", "\u00a0", " \n  ") for s in shapes]
    names = ["legalese", "double-negative", "wordy-phrase", "doublet", "complex-word"]
    rows = parsed(corpus(spark, texts))
    assert rows.where(~F.col("phrases")).count() == 0
    assert audit(corpus(spark, texts), only=names).select("doc").distinct().count() == len(texts)


def test_words_of_sentences(spark):
    texts = ["One two. Three four five! Six", "One  two. Three\tfour.\nFive six", "Dr. No met e.g. it. Done.", "a", "One two.\n\nThree.", "A\u00a0b c.\u3000D"]
    df = corpus(spark, texts).select(marked(F.col("text")).alias("m"))
    for r in df.select("m", sentence_words(F.col("m")).alias("a"), F.transform(F.split("m", "[\x01\x02]"), words_in).alias("b")).collect():
        assert r.a == r.b, r


def test_spelt_words_are_those_with_a_token(spark):
    words = ["ABC", "(ABC)", "\"A.B.\",", "A.B", "ABC.", "ABC..", "ABCDEFG", "xAB", "AB1", "[ABC]:", "AB's", "A.B.C.)", "(\u201cAB\u201d).", "AB).", "A.B..", "{AB}"]
    got = corpus(spark, words).select("text", token_of(F.col("text")).isNotNull().alias("a"), (F.col("text").rlike(CANDIDATE) & F.col("text").rlike(SPELT)).alias("b")).collect()
    assert [r.text for r in got if r.a != r.b] == []


def test_bytes_that_are_no_text(spark):
    rows = corpus(spark, ["x"]).select("doc", F.expr("cast(concat(encode('See [here](http://e.com/', 'utf-8'), X'FF', encode(') we shall.', 'utf-8')) as string)").alias("text"))
    assert {r.rule for r in audit(rows, only=["link-text", "legalese"]).collect()} == {"link-text", "legalese"}
