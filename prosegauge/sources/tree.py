"""Folders of any size to rows, listed and read by tasks: the rows of `read_folder` without a list of names anywhere.

The walk goes in rounds. A task takes folders, walks below them depth first and, once it has listed SPLIT entries, hands
the folders it has not looked into back as rows, which the next round deals over all tasks. A round's entries are a
checkpoint, so a lost executor does not list a folder again. Names are then dealt evenly and each task reads its files.

In mode `all` links are followed; a link to a folder that holds it is a cycle and is left out, told by device and inode
of the folders above it. All else is as in `prosegauge.sources.corpus`. `path` must be one that every machine reaches.
"""

from __future__ import annotations

import os
import re
import stat
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.lexicon import AUDITED, WORKFLOW_PATH
from prosegauge.sources.corpus import SKIPPED_FOLDERS, read_folder

SPLIT = 10_000
ENTRY = "name string, kind string, error string"
ROW = "path string, text string, error string"


def _checkpoint(df: DataFrame) -> DataFrame:
    """spark.checkpoint.dir of the session; a folder of our own only where Spark is one process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def _holds_itself(root: str, name: str) -> bool:
    """Whether a folder is one of those above it."""
    here = os.stat(os.path.join(root, name))
    above = os.path.join(root, os.path.dirname(name))
    while True:
        it = os.stat(above)
        if (it.st_dev, it.st_ino) == (here.st_dev, here.st_ino):
            return True
        if os.path.samefile(above, root):
            return False
        above = os.path.dirname(above)


def entries(root: str, folder: str, mode: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, kind, error) of a folder's entries; kind is `folder`, `file` or `failed`."""
    follow = mode == "all"
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError as e:
        if not folder:
            raise
        yield folder, "failed", str(e)
        return
    for e in found:
        name = os.path.join(folder, e.name)
        if e.is_dir(follow_symlinks=follow):
            if e.name not in SKIPPED_FOLDERS and not (e.is_symlink() and _holds_itself(root, name)):
                yield name, "folder", None
        elif e.is_symlink() and not follow:
            if re.search(AUDITED, e.name.lower()):
                yield name, "failed", "link"
        elif e.is_file(follow_symlinks=follow) and (follow or re.search(AUDITED, e.name.lower())):
            yield name, "file", None


def names(spark: SparkSession, root: str, mode: str = "documents", split: int = SPLIT) -> DataFrame:
    """(name, kind, error) of the files below a folder, and of what could not be looked at."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["name", "kind", "error"])

        todo = [x for batch in batches for x in batch.column(0).to_pylist()]
        listed, out = 0, []
        while todo and listed < split:
            for name, kind, error in entries(root, todo.pop(), mode):
                listed += 1
                if kind == "folder":
                    todo.append(name)
                else:
                    out.append((name, kind, error))
            if len(out) >= 5000:
                yield rows(out)
                out = []
        yield rows(out + [(name, "folder", None) for name in todo])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = spark.createDataFrame([("",)], "name string").coalesce(1)
    found = None
    while True:
        level = _checkpoint(todo.mapInArrow(walk, ENTRY))
        files = level.where("kind <> 'folder'")
        found = files if found is None else found.unionByName(files)
        todo = level.where("kind = 'folder'").select("name")
        if todo.isEmpty():
            return found
        todo = todo.repartition(parts)


def read_tree(spark: SparkSession, root: str, mode: str = "documents", split: int = SPLIT) -> DataFrame:
    """(path, text, error) of a folder, or of a single file."""
    if not stat.S_ISDIR(os.lstat(root).st_mode) and not (mode == "all" and os.path.isdir(root)):
        return read_folder(spark, root, mode)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind, error in zip(*(c.to_pylist() for c in batch.columns)):
                shown, text = name.replace(os.sep, "/"), None
                if kind == "file":
                    try:
                        with open(os.path.join(root, name), "rb") as f:
                            if mode == "documents" or re.search(WORKFLOW_PATH, shown.lower()):
                                text = f.read().decode("utf-8", "replace")
                    except OSError as e:
                        error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (shown, text, error)], names=["path", "text", "error"])

    dealt = names(spark, root, mode, split).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))
    return dealt.mapInArrow(read, ROW)
