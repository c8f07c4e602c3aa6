"""A folder as a stream: what was added, changed or deleted since the last batch, as (path, event, silent, text, error).

Each batch ends at a *listing* of the folder: the time and size of every document, and the folders that could not be
read. Listings are small files in a folder of their own, `listings`; offsets only name them, so the query's checkpoint
does not grow with the corpus. A batch is the difference of two listings, so only files that differ are opened, and a
restart goes on from the last batch that was done. The driver lists names; tasks read the files.

Events: `present` (a new or changed file), `gone` (a deleted one) and `error` (a file that went before it was read). An
entry of a folder that can't be read now stays as it was: a subtree out of reach is not a deletion. A file that may not
be read yet is asked for again with each listing. `silent` marks what was there when the watch began, in subtrees that
were out of reach at that time too, once they can be read: a watcher takes it as a baseline, not as news.

Options: `path`, `listings` (a folder that the driver reaches, kept with the checkpoint).
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from prosegauge.functions.lexicon import AUDITED
from prosegauge.sources.corpus import FILES_A_TASK, SKIPPED_FOLDERS

EMPTY = {"files": {}, "late": [], "first": True}


def listing(root: str, last: dict) -> dict:
    """The folder as it is now. files: path -> [time, size]; late: folders not read since the watch began."""
    files: dict[str, list[int]] = {}
    failed: list[str] = []
    todo = [""]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            if not folder:
                raise
            failed.append(folder)
            continue
        for e in entries:
            name = os.path.join(folder, e.name)
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED_FOLDERS:
                        todo.append(name)
                elif e.is_file(follow_symlinks=False) and re.search(AUDITED, e.name.lower()):
                    is_now = e.stat(follow_symlinks=False)
                    if not stat.S_ISREG(is_now.st_mode):
                        continue
                    if last["files"].get(name) == [is_now.st_mtime_ns, is_now.st_size] or os.access(e.path, os.R_OK):
                        files[name] = [is_now.st_mtime_ns, is_now.st_size]
                    elif name in last["files"]:
                        files[name] = last["files"][name]
                    elif last["first"]:
                        failed.append(name)
            except OSError:  # it went while we looked
                continue
    out_of_reach = tuple(f + os.sep for f in failed)
    files |= {name: was for name, was in last["files"].items() if name.startswith(out_of_reach)}
    late = failed if last["first"] else [f for f in last["late"] if f in failed]
    return {"files": files, "late": late, "first": False}


def difference(start: dict, end: dict) -> list[tuple[str, str, bool]]:
    """(path, event, silent) of what is not the same in two listings, in order of paths."""
    old = tuple(f + os.sep for f in start["late"])
    begun = lambda name: start["first"] or name in start["late"] or name.startswith(old)
    rows = [(name, "present", name not in start["files"] and begun(name)) for name, now in end["files"].items() if start["files"].get(name) != now]
    rows += [(name, "gone", False) for name in start["files"] if name not in end["files"]]
    return sorted(rows)


class Changed(InputPartition):
    def __init__(self, rows: list[tuple[str, str, bool]]) -> None:
        self.rows = rows


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.kept = options["path"], options["listings"]
        os.makedirs(self.kept, exist_ok=True)

    def _names(self) -> list[int]:
        return sorted(int(m[1]) for f in os.listdir(self.kept) if (m := re.fullmatch(r"(\d+)\.json", f)))

    def _read(self, number: int) -> dict:
        if number == 0:
            return EMPTY
        with open(os.path.join(self.kept, f"{number}.json"), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(self._names(), default=0)
        before = self._read(last)
        now = listing(self.root, before)
        if now == before:
            return {"listing": last}
        made = os.path.join(self.kept, f"{last + 1}.json")
        with open(made + ".part", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(made + ".part", made)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        rows = difference(self._read(start["listing"]), self._read(end["listing"]))
        return [Changed(rows[k : k + FILES_A_TASK]) for k in range(0, len(rows), FILES_A_TASK)]

    def read(self, partition: Changed) -> Iterator[tuple]:
        for name, event, silent in partition.rows:
            shown = name.replace(os.sep, "/")
            if event == "gone":
                yield shown, event, silent, None, None
                continue
            try:
                with open(os.path.join(self.root, name), "rb") as f:
                    yield shown, event, silent, f.read().decode("utf-8", "replace"), None
            except OSError as e:
                yield shown, "error", silent, None, str(e)

    def commit(self, end: dict) -> None:
        """Listings before the last batch that is done are not asked for again."""
        for number in self._names():
            if number < end["listing"]:
                os.remove(os.path.join(self.kept, f"{number}.json"))


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watched_corpus"

    def schema(self) -> str:
        return "path string, event string, silent boolean, text string, error string"

    def streamReader(self, schema) -> WatchReader:  # noqa: ANN001, N802
        return WatchReader(self.options)


def watch_folder(spark: SparkSession, path: str, listings: str) -> DataFrame:
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("watched_corpus").option("listings", listings).load(path)
