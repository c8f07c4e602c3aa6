"""Corpora from folders: a Python data source that reads documents as (path, text, error).

Spark's own file readers skip names that begin with `.` or `_` and empty files, and follow links out of the folder;
this source lists with lstat instead. The driver only lists names; tasks read the files, FILES_A_TASK each. Folders
`node_modules` and `.git` are left out at any depth, links are never followed, and what can't be listed or read comes
back as a row with an error and no text. Options: `path` (a folder or one file that every machine reaches) and `mode`,
`documents` (.md, .markdown and .txt) or `all` (every file, links followed, for evidence sweeps).

Filters on `path` (equal, in a list, beginning, end or part, as an extension is an end) reach the source where
`spark.sql.python.filterPushdown.enabled` is on: files that they rule out are listed and not opened.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from prosegauge.functions.lexicon import AUDITED, WORKFLOW_PATH

SKIPPED_FOLDERS = {"node_modules", ".git"}
FILES_A_TASK = 200


class Files(InputPartition):
    def __init__(self, names: list[str], failed: list[tuple[str, str]]) -> None:
        self.names, self.failed = names, failed


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.mode = options["path"], options.get("mode", "documents")
        self.tests: list[Callable[[str], bool]] = []

    def _shown(self, name: str) -> str:
        return (name or os.path.basename(self.root)).replace(os.sep, "/")

    def _list(self) -> tuple[list[str], list[tuple[str, str]]]:
        names, failed = [], []
        top = os.lstat(self.root)
        if stat.S_ISLNK(top.st_mode) and self.mode == "documents":
            return [], [(os.path.basename(self.root), "link")]
        if not stat.S_ISDIR(os.stat(self.root).st_mode):
            if self.mode == "documents" and not re.search(AUDITED, self.root.lower()):
                raise ValueError(f"{self.root} is not a document that can be audited")
            return [""], []
        todo = [""]
        while todo:
            folder = todo.pop()
            try:
                entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
            except OSError as e:
                if not folder:
                    raise
                failed.append((folder, str(e)))
                continue
            for e in entries:
                name = os.path.join(folder, e.name)
                follow = self.mode == "all"
                if e.is_dir(follow_symlinks=follow):
                    if e.name not in SKIPPED_FOLDERS:
                        todo.append(name)
                elif e.is_symlink() and not follow:
                    if re.search(AUDITED, e.name.lower()):
                        failed.append((name, "link"))
                elif e.is_file(follow_symlinks=follow) and (self.mode == "all" or re.search(AUDITED, e.name.lower())):
                    names.append(name)
        return sorted(names), failed

    def partitions(self) -> list[Files]:
        names, failed = self._list()
        wanted = lambda name: all(test(self._shown(name)) for test in self.tests)
        names, failed = [n for n in names if wanted(n)], [f for f in failed if wanted(f[0])]
        cuts = [Files(names[k : k + FILES_A_TASK], []) for k in range(0, len(names), FILES_A_TASK)]
        return [*cuts, Files([], failed)] if failed or not cuts else cuts

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.root, name) if name else self.root
            shown = self._shown(name)
            try:
                # Of all files only workflows are read: for the rest the path decides.
                wanted = self.mode == "documents" or re.search(WORKFLOW_PATH, shown.lower())
                with open(path, "rb") as f:
                    yield shown, f.read().decode("utf-8", "replace") if wanted else None, None
            except OSError as e:
                yield shown, None, str(e)
        for name, why in partition.failed:
            yield name.replace(os.sep, "/"), None, why


class FilteredReader(CorpusReader):
    """The same with filters taken in. Spark lets no reader have this method where pushdown is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("path",) or not isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                yield f
                continue
            # Bound as defaults, each test keeps its own value.
            self.tests.append({
                EqualTo: lambda p, v=f.value: p == v,
                In: lambda p, v=f.value: p in v,
                StringStartsWith: lambda p, v=f.value: p.startswith(v),
                StringEndsWith: lambda p, v=f.value: p.endswith(v),
                StringContains: lambda p, v=f.value: v in p,
            }[type(f)])


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, text string, error string"

    def reader(self, schema) -> CorpusReader:  # noqa: ANN001
        return (FilteredReader if self.options.get("pushdown") == "true" else CorpusReader)(self.options)


def read_folder(spark: SparkSession, path: str, mode: str = "documents") -> DataFrame:
    spark.dataSource.register(CorpusSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("corpus").option("mode", mode).option("pushdown", pushdown).load(path)


def documents(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").select(F.col("path").alias("doc"), "text")


def skipped(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("path", F.col("error").alias("reason"))


def project_acronyms(spark: SparkSession, path: str) -> list[str]:
    """A project's known acronyms from a JSON array; anything unreadable or malformed gives none, and elements that
    are no strings are left out."""
    try:
        found = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]
    except Exception:  # the list is optional, and so is the file
        return []
    words = [w.strip().upper() for a in found if isinstance(a, list) for w in a if isinstance(w, str)]
    return [w for w in words if w]


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(organisation, dimension, criterion, met) from JSON files of answers."""
    rows = spark.read.json(path, multiLine=True, schema="organisation string, dimensions map<string,map<string,boolean>>")
    each = rows.select(F.coalesce("organisation", F.lit("")).alias("organisation"), F.explode_outer("dimensions").alias("dimension", "given"))
    return each.select("organisation", "dimension", F.explode_outer("given").alias("criterion", "met"))
