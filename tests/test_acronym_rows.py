"""The acronym rule as one column: no shuffle, no window, expansions of any length, odd words between, any lexicon."""

import time

import pytest
from prosegauge.operators import acronyms
from prosegauge.operators.acronyms import acronym_undefined
from prosegauge.plans.audit import audit

LONG = ".".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4) + "."
SPELT = " ".join(f"{c.lower()}x" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4)
CASES = {
    f"The {LONG} is it.": [LONG],
    f"The {LONG} ({SPELT}) is it.": [],
    f"The {LONG} ({SPELT} y) is it.": [LONG],
    "CSS (Cascading A.A. Style 1 2 3 Sheets) helps.": ["A.A."],
    "CSS (Cascading 1 2 (3 4 Style (5 Sheets) helps.": [],
    "CSS is a (Cascading Style Sheets) thing.": [],
    "CSS helps, new (Cascading Style Sheets) as it is.": [],
    "CSS is very new (Cascading Style Sheets) thing.": ["CSS"],
    "CSS (Cascading (Style) Sheets) helps.": ["CSS"],
    "CSS (Cascading Style Sheets helps.": ["CSS"],
    "CSS (CSS) helps.": ["CSS"],
    "CSS (C.S.S.) helps.": [],
    "The A.A. (Alpha Beta) meet.": ["A.A."],
    "PLEASE SAVE GNU now.": [],
    "GNU AWS now.": ["GNU", "AWS"],
    "GNU AWS PLEASE SAVE now and GNU goes.": ["GNU"],
    "PLEASE SAVE GNU (Gnu Not Unix) and GNU goes.": [],
    "Part IV and MCMX show, but XL is a size.": ["XL"],
}


def found(spark, text, **given):
    rows = acronym_undefined(spark.createDataFrame([(1, text)], "doc bigint, text string"), **given).orderBy("ord").collect()
    return [r.detail.split('"')[1] for r in rows]


def test_cases(spark):
    corpus = spark.createDataFrame(list(enumerate(CASES)), "doc bigint, text string")
    got = {}
    for r in acronym_undefined(corpus).orderBy("doc", "ord").collect():
        got.setdefault(r.doc, []).append(r.detail.split('"')[1])
    assert [(t, got.get(k, [])) for k, t in enumerate(CASES) if got.get(k, []) != CASES[t]] == []


def test_one_scan_without_shuffle_or_window(spark, tmp_path):
    spark.createDataFrame([(1, "The GNU tools.")], "doc bigint, text string").write.parquet(f"{tmp_path}/c")
    plan = audit(spark.read.parquet(f"{tmp_path}/c"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("FileScan") == 1


def test_a_large_table_of_words_is_joined(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, "PLEASE SAVE it. The GNU."), (1, "PLEASE SAVE it. The GNU."), (None, "PLEASE SAVE it. AWS."), (2, "PLEASE ZZZ"), (3, "plain"), (4, None)], "doc bigint, text string")
    table = spark.createDataFrame([(w,) for w in ["please", "save", "save", None, "other"]], "word string")
    want = sorted((str(r.doc), r.detail, r.line) for r in acronym_undefined(corpus, table).collect())
    assert len(want) == 4
    monkeypatch.setattr(acronyms, "LISTED", 2)
    joined = acronym_undefined(corpus, table)
    assert sorted((str(r.doc), r.detail, r.line) for r in joined.collect()) == want
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("unit", ["ABC ", "ABC (", "(A B) ", "A.B. (ax bx) ", "XIV "])
def test_growth_is_linear(spark, unit):
    def seconds(n):
        corpus = spark.createDataFrame([(1, unit * n)], "doc bigint, text string")
        began = time.time()
        acronym_undefined(corpus).collect()
        return time.time() - began

    base = min(seconds(2) for _ in range(2))
    small, large = (max(0.5, seconds(n) - base) for n in (15_000, 45_000))
    assert large / small < 5
