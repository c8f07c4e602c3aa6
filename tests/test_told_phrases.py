"""Short texts with structure: what the looks by Arrow tell spares the columns' patterns, and findings stay the same."""

from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.operators.markdown import structure
from prosegauge.operators.rules import SAID
from prosegauge.operators.structure import parsed
from prosegauge.plans import audit as plans

TEXTS = [
    "> We shall go\n> in order\n> to win. Dr. No shall not.",
    "# One. Two\n\nNull and void, not unlike NULL AND VOID.\n\nUtilise it",
    "- the report Terms And Conditions, `shall` and \"null and void\" shall\n- utilise2 utilize",
    "a ſhall b _shall shall_ shall-be it's shall",
    "<b>x</b> " + "One two three. " * 11 + "x",
    "<i>" + "long " * 40 + "</i> end. Next e.g. this.",
    "*I*_n_ conclusion, it ends.\n\n| a | |\n|---|---|\n",
]
NAMES = [n for n in lex.RULES if n != plans.ACRONYM]


def test_findings_are_those_of_the_patterns(spark):
    rows = parsed(spark.createDataFrame([(k, f.format(t)) for k, t in enumerate(TEXTS) for f in ("{}", "See [x](y).\n\n{}")], "doc bigint, text string"))
    by_patterns = {"said": F.array().cast(SAID), **{x: F.when(F.lit(False), F.col(x)) for x in ("parts", "sentences")}}
    plain = rows.withColumns({**by_patterns, **{x: F.lit(True) for x in ("searched", "openers", "tables", "lengthy", "ranks")}})
    found = [sorted(map(tuple, plans.document_findings(r, NAMES).collect())) for r in (rows, plain)]
    assert found[0] == found[1] and {x[1] for x in found[0]} >= {"legalese", "doublet", "wordy-phrase", "complex-word", "double-negative", "sentence-length", "table-header"}


def test_short_texts_are_not_searched_again(spark):
    texts = ["> We shall go\n> in order\n> to win.", "# Head\n\nNull and void.", "We shall."]
    rows = parsed(spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")).orderBy("doc").collect()
    assert [(r.searched, r.lengthy, r.acronyms, [x.phrase.lower() for x in r.said]) for r in rows] == [
        (False, False, False, ["shall", "in order\nto"]), (False, False, False, ["null and void"]), (False, False, False, ["shall"]),
    ]


def test_a_run_of_ticks_behind_an_escape():
    assert structure("x \\``` y `` z")["blocks"] == [{"line": 1, "text": "x ``` y ``\x04 z"}]
    assert structure("x \\``` y")["blocks"] == [{"line": 1, "text": "x ``` y"}]
