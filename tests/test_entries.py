"""Command line, JSON files, SQL functions."""

import json

import pytest
from prosegauge.__main__ import main
from prosegauge.functions.sql import register


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "training").mkdir(parents=True)
    (root / "b.md").write_text("We shall utilise it.")
    (root / "a|x.md").write_text("### Deep\n\n##### Deeper\n\nWe hereby shall.")
    (root / "training" / "clean.txt").write_text("Fine.")
    (root / "link.md").symlink_to(root / "b.md")
    return root


def test_corpus(spark, folder, tmp_path, capsys):
    out = tmp_path / "f.json"
    assert main([str(folder), "--json", str(out), "--out", str(tmp_path / "lines")]) == 0
    said = capsys.readouterr()
    assert "| legalese | 3 |" in said.out and "6 findings in 3 files" in said.out and "skipped link.md" in said.err
    got = json.loads(out.read_text())
    assert got["configHash"] == "ca6f9562" and list(got["files"]) == ["a|x.md", "b.md", "training/clean.txt"] and got["skipped"] == ["link.md"]
    assert got["files"]["training/clean.txt"] == {"violations": []}
    assert [v["rule"] for v in got["files"]["b.md"]["violations"]] == ["legalese", "complex-word"]
    assert list(got["totals"].items()) == [("legalese", 3), ("heading-depth", 1), ("heading-skip", 1), ("complex-word", 1)]
    assert {r.path: len(r.violations) for r in spark.read.json(str(tmp_path / "lines" / "files")).collect()} == {"a|x.md": 4, "b.md": 2, "training/clean.txt": 0}


def test_text(spark, folder, capsys):
    (folder / ".prosegauge").mkdir()
    (folder / ".prosegauge" / "acronyms.json").write_text('["css", 3, null, ""]')
    (folder / "training" / "t.md").write_text("CSS and GNU.")
    assert main(["text", str(folder / "training" / "t.md"), "--project", str(folder)]) == 0
    said = capsys.readouterr().out
    assert '| training/t.md | 1 | acronym-undefined | define acronym "GNU" on first use |' in said and "Findings: 1. Files read: 1. Skipped: 0." in said
    assert main(["text", str(folder)]) == 0
    assert "a\\|x.md | 5 | legalese" in capsys.readouterr().out


def test_report_from_files(spark, folder, tmp_path, capsys):
    names = {n: str(tmp_path / f"{n}.json") for n in ("f", "e", "m", "s")}
    (tmp_path / "answers.json").write_text(json.dumps({"organisation": "o", "dimensions": {"governance": {"policy-documented": True}}}))
    (tmp_path / "none.json").write_text("{}")
    assert main(["corpus", str(folder), "--json", names["f"]]) == main(["evidence", str(folder), "--json", names["e"]]) == main(["maturity", str(tmp_path / "answers.json"), "--json", names["m"]]) == 0
    assert json.loads((tmp_path / "e.json").read_text())["artefacts"]["training"] == {"found": True, "paths": ["training/clean.txt"]}
    assert json.loads((tmp_path / "m.json").read_text())["dimensions"]["governance"] == {"level": 1, "missing": ["owner-accountable"]}
    for day in ("2024-01-01", "2024-02-01"):
        assert main(["report", names["f"], names["e"], names["m"], "--state", names["s"], "--out", str(tmp_path / "r.md")], now=day) == 0
    text = (tmp_path / "r.md").read_text()
    assert "| 2024-01-01 | 0 | 6 |" in text and "| legalese | 3 |" in text and "| training | yes | training/clean.txt |" in text
    assert len(json.loads((tmp_path / "s.json").read_text())["snapshots"]) == 2
    assert main(["maturity", str(tmp_path / "none.json")]) == 0 and "Overall: 0" in capsys.readouterr().out


@pytest.mark.parametrize("args", [[], ["corpus"], ["corpus", "a", "b"], ["corpus", "a", "--json"], ["corpus", "a", "--odd"], ["report", "a"], ["text"]])
def test_wrong_usage(args, capsys):
    assert main(args) == 2


def test_failures(spark, tmp_path, capsys):
    assert main(["corpus", str(tmp_path / "missing")]) == 1
    assert main(["report", "no", "no", "no"]) == 1


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "# Head\n\nOne [here](/x).\n\n> two"), (2, None)], "id int, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("select id, line, text from texts, lateral md_blocks(t) order by line").collect()] == [(1, 3, "One here."), (1, 5, "two")]
    assert [tuple(r) for r in spark.sql("select id, level, text from texts, lateral md_headings(t)").collect()] == [(1, 1, "Head")]
    assert [tuple(r) for r in spark.sql("select kind, label, target from texts, lateral md_links(t)").collect()] == [("inline", "here", "/x")]
    r = spark.sql("select word_count('a  b\u00a0c') as w, line_at('a\nb', 2) as l, table_cell('a|b\nc') as c, config_hash() as h").first()
    assert tuple(r) == (3, 2, "a\\|b c", "ca6f9562")
