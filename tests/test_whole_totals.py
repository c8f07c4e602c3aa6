"""Totals over all seventeen rules, by rule and by document, against a fixture and counts made by hand."""

from collections import Counter

from prosegauge.plans import registry

#: Text of a document -> the rules of its findings, one a finding.
FIXTURE = [
    ("We use the GNU tools.", ["acronym-undefined"]),
    ("We shall utilise it.", ["legalese", "complex-word"]),
    ("Each and every one.", ["doublet"]),
    ("We do it in order to win.", ["wordy-phrase"]),
    ("It is not unlike the rest.", ["double-negative"]),
    ("# One\n\n### Two\n\nBody.", ["heading-skip"]),
    ("See [here](http://example.com) for it.", ["link-text"]),
    ("See ![](a.png) for it.", ["image-alt"]),
    ("| a |  |\n|---|---|\n| b | 1 |", ["table-header"]),
    ("One. Two. Three. Four. Five. Six.", ["paragraph-length"]),
    ("A clean text.", []),
    (None, []),
]


def test_totals_of_all_rules(spark, tmp_path):
    rows = [(k, text) for k, (text, _) in enumerate(FIXTURE)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.rule: r.n for r in registry.queries()["rule_totals"](spark, str(tmp_path)).collect()}
    assert got == Counter(rule for _, rules in FIXTURE for rule in rules)
    got = {r.doc_id: (r.n_violations, r.n_rules) for r in registry.queries()["files_summary"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(rules), len(set(rules))) for k, (_, rules) in enumerate(FIXTURE)}
