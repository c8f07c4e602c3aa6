"""A table of Parquet files that manifests commit: for findings, counts and the history of audits, from batches and
streams.

Tasks write files with names of their own below `data`; the driver gets these names alone and writes one manifest for
the whole batch below `commits`, after which its rows exist. What a failed task or an aborted job leaves is in no
manifest and never read. A manifest is named by the batch: where it is there already, the batch was written before, and
its files of this time go. So a repeat is harmless. Readers read the files that manifests name, a task each.

Options: `path` (any that pyarrow's file systems reach, from all machines) and, for batch writes, `batch`, a name by
which a repeat is told; without it each write is a batch of its own. `vacuum` deletes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[str]:
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


class _Work:
    """What batch and stream have in common."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.batch, self.schema = options["path"], options.get("batch") or uuid.uuid4().hex, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return Written([], 0)
        name, rows = f"{uuid.uuid4().hex}.parquet", 0
        files.create_dir(f"{root}/data", recursive=True)
        with files.open_output_stream(f"{root}/data/{name}") as out, pq.ParquetWriter(out, first.schema) as writer:
            batch = first
            while batch is not None:
                writer.write_batch(batch)
                rows += batch.num_rows
                batch = next(batches, None)
        return Written([name], rows)

    def finish(self, messages: list[Written | None], batch: str) -> None:
        files, root = _open(self.path)
        target = f"{root}/commits/{batch}.json"
        if files.get_file_info(target).type != fs.FileType.NotFound:
            self.undo(messages)
            return
        files.create_dir(f"{root}/commits", recursive=True)
        made = [m for m in messages if m is not None]
        body = {"files": [f for m in made for f in m.files], "rows": sum(m.rows for m in made)}
        part = f"{root}/commits/{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as out:
            out.write(json.dumps(body).encode())
        files.move(part, target)

    def undo(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            files.delete_file(f"{root}/data/{name}")


class BatchWriter(_Work, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages, f"b-{self.batch}")

    def abort(self, messages: list[Written | None]) -> None:
        self.undo(messages)


class StreamWriter(_Work, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.finish(messages, f"s-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.undo(messages)


class OneFile(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema

    def partitions(self) -> list[OneFile]:
        files, _ = _open(self.path)
        names = [n for m in _manifests(self.path) for n in json.loads(files.open_input_stream(m).read())["files"]]
        return [OneFile(n) for n in names] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = _open(self.path)
        want = to_arrow_schema(self.schema)
        with files.open_input_file(f"{root}/data/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=8192, columns=want.names):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(want.field(n).type) for n in want.names], schema=want)


class CommittedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> StructType:
        files, root = _open(self.options["path"])
        for m in _manifests(self.options["path"]):
            for name in json.loads(files.open_input_stream(m).read())["files"]:
                from pyspark.sql.pandas.types import from_arrow_schema

                with files.open_input_file(f"{root}/data/{name}") as f:
                    return from_arrow_schema(pq.ParquetFile(f).schema_arrow)
        raise ValueError(f"{self.options['path']} holds no rows; read it with a schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("committed tables are appended to")
        return BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedTable)


def append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds rows; those of a batch that was written before are not added again."""
    register(rows.sparkSession)
    writer = rows.write.format("committed").mode("append")
    (writer if batch is None else writer.option("batch", batch)).save(path)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("committed")
    return (reader if schema is None else reader.schema(schema)).load(path)


def vacuum(path: str) -> int:
    """Deletes files that no manifest names. Only for times at which nothing is being written."""
    files, root = _open(path)
    named = {n for m in _manifests(path) for n in json.loads(files.open_input_stream(m).read())["files"]}
    gone = 0
    for f in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
        if f.base_name not in named:
            files.delete_file(f.path)
            gone += 1
    return gone
