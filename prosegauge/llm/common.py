"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach: spark.checkpoint.dir of the session.

    Only where that is unset and all of Spark runs in one process (tests) a folder of our own under /tmp takes its
    place. A cluster without it gets an error: files in a machine's own folder are lost to all others.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share; it is unset on {master}")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts the lineage: what is lost with an executor is read again from the shared folder.
    """
    path = shared_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small_parts(batch: pa.RecordBatch, column: int, rows: int = 500, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `rows` rows, and at most `most` bytes of a text column unless one row has more."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at : at + rows], dtype=np.int64)
        n = max(1, int(np.searchsorted(total, most, "right")))
        yield batch.slice(at, n)
        at += n


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def id_bucket(col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, picked by a hash of `key`, the same ones each time.

    A count sizes a hash threshold first, so that only about 1.3 times the bound (at least) reaches the
    final top-k, however large df is.
    """
    total = df.select(key).count()
    order = F.xxhash64(F.col(key).cast("string"))
    if total > 2 * rows:
        slots = 1 << 30
        limit = int(slots * min(1.0, (1.3 * rows + 200) / total))
        df = df.where(F.pmod(order, F.lit(slots)) < limit)
        return df.orderBy(F.pmod(order, F.lit(slots)), F.col(key)).limit(rows)
    return df.orderBy(order, F.col(key)).limit(rows)
