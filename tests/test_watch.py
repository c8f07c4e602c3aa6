"""The watched folder, the state of the running audit, and the table that manifests commit."""

import json
import os

import pytest
from prosegauge.sources import committed
from prosegauge.sources.watch import EMPTY, WatchReader, difference, listing
from prosegauge.streaming.watch import watch
from pyspark.sql import functions as F


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_listings_and_their_difference(tmp_path, monkeypatch):
    put(tmp_path, "a.md", "one")
    put(tmp_path, "sub/b.md", "two")
    put(tmp_path, "node_modules/c.md", "no")
    put(tmp_path, "d.py", "no")
    scandir, shut = os.scandir, set()

    def guarded(path):
        if os.path.relpath(path, tmp_path) in shut:
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", guarded)
    shut.add("sub")
    first = listing(str(tmp_path), EMPTY)
    assert difference(EMPTY, first) == [("a.md", "present", True)] and first["late"] == ["sub"]
    shut.clear()
    second = listing(str(tmp_path), first)
    assert difference(first, second) == [("sub/b.md", "present", True)] and not second["late"]
    shut.add("sub")
    put(tmp_path, "e.txt", "new")
    third = listing(str(tmp_path), second)
    assert difference(second, third) == [("e.txt", "present", False)]  # out of reach is not gone
    shut.clear()
    os.remove(tmp_path / "sub/b.md")
    put(tmp_path, "a.md", "longer than before")
    assert difference(third, listing(str(tmp_path), third)) == [("a.md", "present", False), ("sub/b.md", "gone", False)]
    shut.add(".")
    with pytest.raises(PermissionError):
        listing(str(tmp_path), third)


def test_reader_names_listings_and_drops_old_ones(tmp_path):
    put(tmp_path / "in", "a.md", "one")
    reader = WatchReader({"path": str(tmp_path / "in"), "listings": str(tmp_path / "kept")})
    start, one = reader.initialOffset(), reader.latestOffset()
    assert reader.latestOffset() == one == {"listing": 1}
    assert [list(reader.read(p)) for p in reader.partitions(start, one)] == [[("a.md", "present", True, "one", None)]]
    put(tmp_path / "in", "b.md", "two")
    # A new reader, as after a restart, goes on from there.
    reader = WatchReader({"path": str(tmp_path / "in"), "listings": str(tmp_path / "kept")})
    two = reader.latestOffset()
    parts = reader.partitions(one, two)
    os.remove(tmp_path / "in/b.md")
    assert [r[:2] for p in parts for r in reader.read(p)] == [("b.md", "error")]
    reader.commit(two)
    assert os.listdir(tmp_path / "kept") == ["2.json"]


def run(spark, tmp_path):
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), rules=["legalese", "complex-word"]).awaitTermination()
    manifests = committed._manifests(str(tmp_path / "out"))
    rows = committed.read(spark, str(tmp_path / "out"), "path string, rule string, before int, now int, change int").collect()
    return len(manifests), sorted((r.path, r.rule, r.before, r.now) for r in rows)


def test_a_watch_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.md", "We shall go.\n\nThey shall utilise it.")
    put(folder, "clean.md", "We go.")
    _, rows = run(spark, tmp_path)
    assert rows == []  # what was there is a silent baseline
    put(folder, "a.md", "We shall go.")
    put(folder, "new.md", "They shall.")
    os.remove(folder / "clean.md")
    n, rows = run(spark, tmp_path)
    want = [("a.md", "complex-word", 1, 0), ("a.md", "legalese", 2, 1), ("new.md", "legalese", 0, 1)]
    assert rows == want
    assert run(spark, tmp_path) == (n, want)  # nothing changed, nothing is repeated
    os.remove(folder / "a.md")
    want = sorted([*want, ("a.md", "legalese", 1, 0)])
    assert run(spark, tmp_path)[1] == want
    put(folder, "a.md", "We shall go.")  # its state went with it, so it comes as news
    assert run(spark, tmp_path)[1] == sorted([*want, ("a.md", "legalese", 0, 1)])


def test_committed_rows_exist_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select("id", F.concat(F.lit("x"), "id").alias("s")).repartition(4)
    committed.append(rows, path, "one")
    committed.append(rows, path, "one")
    committed.append(rows.where("id < 10"), path)
    back = committed.read(spark, path)
    assert back.count() == 110 and back.select("id", "s").distinct().count() == 100
    assert committed.vacuum(path) == 0
    committed.append(rows.where("id < 0"), path, "none")
    assert committed.read(spark, path).count() == 110


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        committed.append(broken, path, "one")
    assert committed.read(spark, path, "id bigint").count() == 0
    committed.append(spark.range(100), path, "one")
    assert committed.read(spark, path).count() == 100
    committed.vacuum(path)
    named = sum((json.load(open(m))["files"] for m in committed._manifests(path)), [])
    assert sorted(os.listdir(f"{path}/data")) == sorted(named)
