"""Folders listed by tasks give the rows of the driver's listing; filters on paths keep files closed."""

import os

import pytest
from prosegauge.sources.corpus import FilteredReader, read_folder
from prosegauge.sources.tree import names, read_tree
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringContains, StringEndsWith, StringStartsWith


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for k in range(30):
        sub = top / f"d{k % 3}" / f"e{k % 5}" / ".hidden"
        sub.mkdir(parents=True, exist_ok=True)
        (sub / f"f{k}.md").write_text(f"text {k}")
    (top / "empty.txt").write_text("")
    (top / "note.py").write_text("x")
    (top / "bad.md").write_bytes(b"\xff\xfe")
    (top / "node_modules").mkdir()
    (top / "node_modules" / "no.md").write_text("no")
    os.symlink(top / "empty.txt", top / "link.md")
    os.symlink(top / "d0", top / "linked")
    os.symlink(top / "gone", top / "broken.md")
    (top / ".github" / "workflows").mkdir(parents=True)
    (top / ".github" / "workflows" / "lint.yml").write_text("run: vale .")
    return str(top)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode", ["documents", "all"])
@pytest.mark.parametrize("split", [2, 10_000])
def test_same_rows_as_the_listing_on_the_driver(spark, folder, mode, split):
    want = rows(read_folder(spark, folder, mode))
    assert rows(read_tree(spark, folder, mode, split)) == want and len(want) > 30


def test_cycles_end(spark, folder, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "a" / "b" / "up")
    os.symlink(tmp_path, tmp_path / "a" / "top")
    assert [r.name for r in names(spark, str(tmp_path), "all").collect()] == ["a/b/x.md"]
    assert rows(read_tree(spark, f"{folder}/empty.txt")) == [("empty.txt", "", None)]
    with pytest.raises(Exception):
        read_tree(spark, f"{folder}/absent").collect()


def test_filters_keep_files_closed(folder):
    def left(*filters):
        reader = FilteredReader({"path": folder, "mode": "all"})
        return list(reader.pushFilters(list(filters))), sum(len(p.names) for p in reader.partitions())

    path = ("path",)
    every = left()[1]
    assert left(StringEndsWith(path, ".yml")) == ([], 1) and left(StringStartsWith(path, "d1/"))[1] == 10
    assert left(EqualTo(path, "note.py"))[1] == 1 and left(In(path, ("note.py", "empty.txt", "no")))[1] == 2
    assert left(StringContains(path, "f2"), StringStartsWith(path, "d2/"))[1] < 10
    assert left(IsNotNull(path)) == ([IsNotNull(path)], every) and left(EqualTo(("text",), "x")) == ([EqualTo(("text",), "x")], every)


def test_filters_reach_the_source(spark, folder):
    on = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(on)
    try:
        spark.conf.set(on, "true")
        df = read_folder(spark, folder).where("path like 'd1/%' and path like '%.md'")
        assert df.count() == 10 and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set(on, before)
