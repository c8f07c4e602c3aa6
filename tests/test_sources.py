import json
import os

from prosegauge.operators import governance
from prosegauge.plans import report
from prosegauge.plans.audit import totals
from prosegauge.sources.corpus import documents, project_acronyms, read_answers, read_folder, skipped
from prosegauge.streaming.hook import after_write
from prosegauge.streaming.monitor import changes, monitor


def test_folder_scan(spark, tmp_path):
    for name in ("_draft.md", ".hidden.TXT", "sub/a.markdown", "node_modules/x.md", ".git/y.md", "z.py", "empty.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name == "empty.md" else "We shall.")
    os.symlink(tmp_path / "sub", tmp_path / "loop")
    os.symlink(tmp_path / "z.py", tmp_path / "link.md")
    rows = read_folder(spark, str(tmp_path))
    assert sorted(r.doc for r in documents(rows).collect()) == [".hidden.TXT", "_draft.md", "empty.md", "sub/a.markdown"]
    assert [r.path for r in skipped(rows).collect()] == ["link.md"]
    one = read_folder(spark, str(tmp_path / "_draft.md")).collect()
    assert [(r.path, r.text) for r in one] == [("_draft.md", "We shall.")]


def test_evidence_and_maturity(spark, tmp_path):
    (tmp_path / "workflows").mkdir()
    (tmp_path / "workflows" / "text.yml").write_text("run: lint")
    (tmp_path / "Style-Guide.md").write_text("x")
    (tmp_path / "acronyms.json").write_text('[" css ", 3, "", "Sql"]')
    (tmp_path / "answers.json").write_text(json.dumps({"organisation": "o", "dimensions": {"governance": {"policy-documented": True, "owner-accountable": True, "executive-review-cycle": True}, "odd": {"x": True}}}))
    found = governance.evidence(read_folder(spark, str(tmp_path), "all").selectExpr("path", "text as content"))
    seen = {r.category: r.n_paths for r in governance.evidence_found(spark, found).collect()}
    assert seen == {"policy": 1, "review-workflow": 0, "automated-checks": 1, "training": 0, "glossary": 0}
    levels = governance.maturity(read_answers(spark, str(tmp_path / "answers.json")))
    assert {(r.dimension, r.level, r.missing) for r in levels.collect()} == {
        ("governance", 2, "resourced-mandated"), ("capability", 0, "style-guide-available"), ("process", 0, "review-step-exists"),
        ("measurement", 0, "corpus-baseline-taken"), ("culture", 0, "leadership-aware"),
    }
    assert governance.overall(levels).first().overall == 0
    assert "CSS" in project_acronyms(spark, str(tmp_path / "acronyms.json"))
    assert project_acronyms(spark, str(tmp_path / "nothing.json")) == []


def test_report_and_history(spark, tmp_path):
    found = spark.createDataFrame([("legalese",), ("legalese",)], "rule string")
    path = str(tmp_path / "state")
    report.append_snapshot(totals(found), 1, "2024-01-01", path)
    report.append_snapshot(totals(found.limit(0)), 2, "2024-02-01", path)
    shots = spark.read.parquet(path)
    assert sorted((r.timestamp, r.total) for r in report.history(shots).collect()) == [("2024-01-01", 2), ("2024-02-01", 0)]
    answers = spark.createDataFrame([("o", "governance", "policy-documented", True)], "organisation string, dimension string, criterion string, met boolean")
    none = spark.createDataFrame([], "path string, content string")
    text = report.markdown(totals(found), governance.evidence_found(spark, governance.evidence(none)), governance.maturity(answers), shots)
    assert "| legalese | 2 |" in text and "## Trend" in text and "| governance | 1 | owner-accountable |" in text


def test_monitor(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    common = spark.createDataFrame([], "word string")
    for k, text in enumerate(("We shall. They shall.", "We go.")):
        (folder / f"{k}.json").write_text(json.dumps({"doc": "a", "text": text}))
        stream = spark.readStream.schema("doc string, text string").json(str(folder))
        monitor(stream, out, str(tmp_path / "check"), common, ["legalese"]).awaitTermination()
    got = changes(spark.read.parquet(f"{out}/counts")).collect()
    assert [(r.doc, r.rule, r.change) for r in got] == [("a", "legalese", -2)]


def test_hook_says_one_line_a_rule(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps({"doc": d, "text": t}) for d, t in (("b", "We shall. They shall."), ("a", "Ok.\n\nWe shall utilise it."), ("c", None))))
    for on, want in ((True, ["legalese: 3 in 2 documents, first at a:3", "complex-word: 1 in 1 documents, first at a:3"]), (False, [])):
        said = []
        stream = spark.readStream.schema("doc string, text string").json(str(folder))
        after_write(stream, said.append, str(tmp_path / f"check-{on}"), on).awaitTermination()
        assert said == want
