"""Token ids in sorted-string tables: documents by key in prefix-compressed blocks, found by binary search.

A shard holds a run of documents in key order:

  block*   entries of (shared key bytes, own key bytes, key rest, number of ids, ids as little-endian integers of two
           bytes, or of four for vocabularies that need them); the first entry of a block spells its key in full,
           later ones only what differs from the key before
  index    for each block its first key, offset and length (sparse: one key a block)
  filter   a Bloom filter of the keys
  footer   offsets and lengths of index and filter, number of documents and ids, bytes an id, format version, magic

A key is the document id as eight big-endian bytes with the sign bit flipped (so byte order is number order) and four
bytes that number the rows of one id within a task's shards.

`write` splits the documents by ranges of the id, encodes and writes each range's shards from the task that holds it,
and returns the manifest: one row a shard. Tasks hand over shards only through the manifest; a task that runs again
writes a shard of another name, so a lost executor leaves at most files that nothing names. `read` gets all documents
back, `lookup` finds single ones by filter, index and block.

Cases: a null text counts as empty and has the end id alone; rows with a null id come first, in keys below all others,
and read back as null; rows that repeat an id are numbered in the order of their texts' hashes; an empty table writes
no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import materialize, shared_path, small_parts

MAGIC, VERSION = b"PGSST\x00\r\n", 1
#: A block is closed at this many bytes, a shard at this many; a longer document has a block of its own.
BLOCK, SHARD = 64 << 10, 32 << 20
BITS_PER_KEY, PROBES = 10, 7
END_ID = 2
#: Beyond so many shards a task reads several.
MOST_TASKS = 20_000
#: Shards whose first ids may be broadcast, about 100 bytes each; beyond it the ids are sorted past them.
BROADCAST_SHARDS = 100_000
FOOTER = struct.Struct("<QQQQQQII8s")


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) + (1 << 63)) % (1 << 64), copy)


def id_of(key: bytes) -> int | None:
    some, number, _ = struct.unpack(">BQI", key)
    return number - (1 << 63) if some else None


def _probes(doc_id: int | None, bits: int) -> Iterator[int]:
    """Places of an id in a Bloom filter, from two halves of one hash."""
    import xxhash

    h = xxhash.xxh64_intdigest(key_of(doc_id))
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return ((a + k * b) % bits for k in range(PROBES))


class ShardWriter:
    """Collects one shard in memory; its size is bounded by SHARD and the longest document."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.blocks: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[int | None] = []
        self.block = bytearray()
        self.first = self.last = b""
        self.size = self.n_ids = 0

    def add(self, doc_id: int | None, copy: int, ids: bytes) -> None:
        key = key_of(doc_id, copy)
        if len(self.block) + len(ids) > BLOCK and self.block:
            self._close_block()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        n = len(ids) // 4
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<I", n) + ids
        self.last = key
        self.ids.append(doc_id)
        self.n_ids += n

    def _close_block(self) -> None:
        self.index.append((self.first, self.size, len(self.block)))
        self.blocks.append(bytes(self.block))
        self.size += len(self.block)
        self.block = bytearray()

    def full(self) -> bool:
        return self.size + len(self.block) >= SHARD

    def finish(self) -> bytes:
        if self.block:
            self._close_block()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.ids) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for doc_id in self.ids:
            bloom[list(_probes(doc_id, bits))] = True
        bloom = np.packbits(bloom).tobytes()
        footer = FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), len(self.ids), self.n_ids, self.width, VERSION, MAGIC)
        return b"".join([*self.blocks, index, bloom, footer])


def block_entries(block: bytes, width: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as little-endian uint32) of a block."""
    at, key = 0, b""
    while at < len(block):
        shared, own = block[at], block[at + 1]
        at += 2
        key = key[:shared] + block[at : at + own]
        (n,) = struct.unpack_from("<I", block, at + own)
        at += own + 4
        ids = block[at : at + width * n]
        yield id_of(key), np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids
        at += width * n


class ShardReader:
    """Reads a shard from any file system that pyarrow knows, block by block."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(FOOTER.size, size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, self.width, version, magic = FOOTER.unpack(foot)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not a shard of this format")
        raw, at, self.index = self.file.read_at(index_size, index_at), 0, []
        while at < len(raw):
            n = raw[at]
            self.index.append((raw[at + 1 : at + 1 + n], *struct.unpack_from("<QI", raw, at + 1 + n)))
            at += n + 13
        self.firsts = [key for key, _, _ in self.index]
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_size, bloom_at), np.uint8)).astype(bool)

    def entries(self) -> Iterator[tuple[int | None, bytes]]:
        for _, at, n in self.index:
            yield from block_entries(self.file.read_at(n, at), self.width)

    def get(self, doc_id: int | None) -> bytes | None:
        """The ids of a document (of the first row, if the id repeats), or None if the shard lacks it."""
        import bisect

        if not all(self.bloom[k] for k in _probes(doc_id, len(self.bloom))):
            return None
        k = bisect.bisect_right(self.firsts, key_of(doc_id)) - 1
        if k < 0:
            return None
        _, at, n = self.index[k]
        return next((ids for found, ids in block_entries(self.file.read_at(n, at), self.width) if found == doc_id), None)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer: str, folder: str, partitions: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the shards below folder (a URI that every machine reaches) and returns the manifest:
    (shard, first_id, part, number, n_docs, n_ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from prosegauge.llm.bpe import encoder_of

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        encoder, end = encoder_of(tokenizer, library=True), struct.pack("<I", end_id)
        width = 2 if max(end_id, encoder.rules.get_vocab_size() - 1) < 1 << 16 else 4
        number, writer = 0, ShardWriter(width)
        before, copy = object(), 0

        def flush() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{number:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(writer.finish())
            row = {"shard": f"{folder}/{name}", "first_id": writer.ids[0], "part": context.partitionId(), "number": number, "n_docs": len(writer.ids), "n_ids": writer.n_ids}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.string()), ("first_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for part in small_parts(batch, 1, rows=2000):
                found, ends = encoder.encode_all(part.column(1))
                raw = found.astype("<u4").tobytes()
                for doc_id, a, b in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    copy = copy + 1 if doc_id == before else 0
                    before = doc_id
                    writer.add(doc_id, copy, raw[4 * a : 4 * b] + end)
                    if writer.full():
                        yield flush()
                        number, writer = number + 1, ShardWriter(width)
        if writer.ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows of one id (or of none) may be many: their texts' hashes and a row number split them over several ranges.
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    ranged = rows.repartitionByRange(partitions, "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")
    return materialize(ranged.mapInArrow(work, "shard string, first_id bigint, part int, number int, n_docs bigint, n_ids bigint"), "manifest")


def _tasks(manifest: DataFrame) -> int:
    """Tasks that read shards; the manifest is a stored table of one row a shard."""
    return max(1, min(manifest.count(), MOST_TASKS))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of all documents, from the shards: start counts the ids of all
    documents before it. The running total goes over the manifest, which has one row a shard."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    # A task for each shard: left to itself, Spark would merge these few small rows into one.
    spread = base.select("shard", "base").repartition(_tasks(manifest), "shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(shard)
                rows = []
                for doc_id, ids in reader.entries():
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                reader.close()
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([shard] * len(rows))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return spread.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard string")


def lookup(wanted: DataFrame, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted ids that some shard holds. Ranges of shards do not overlap but for rows that repeat
    an id across their edge, so each id goes to the last shard that begins at or below it; then one Bloom test, one
    search in the index and one block. Wanted ids are taken once each; null ids are not looked up.

    The shards' first ids are broadcast as one sorted array where there are few enough, and the wanted ids search it;
    beyond BROADCAST_SHARDS both are sorted by id together, and each wanted id takes the shard that stands before it."""
    ask = wanted.select(F.col(id_col).cast("bigint").alias("k")).where("k is not null").distinct()
    bounds = manifest.where("first_id is not null").groupBy(F.col("first_id").alias("k")).agg(F.max_by("shard", F.struct("part", "number")).alias("shard"))
    if manifest.count() <= BROADCAST_SHARDS:
        rows = sorted((r.k, r.shard) for r in bounds.collect())
        firsts = manifest.sparkSession.sparkContext.broadcast(([k for k, _ in rows], [s for _, s in rows]))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, shards = firsts.value
            for batch in batches:
                at = np.searchsorted(np.array(keys, np.int64), batch.column(0).to_numpy(zero_copy_only=False), "right") - 1
                names = pa.array([shards[i] if i >= 0 else None for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, batch.column(0)], names=["shard", "doc_id"])

        found = ask.mapInArrow(place, "shard string, doc_id bigint").where("shard is not null")
    else:
        both = bounds.select("k", "shard", F.lit(0).alias("side")).union(ask.select("k", F.lit(None).cast("string"), F.lit(1)))
        # Ranges first, so that no task sees all; what a range lacks at its head comes from the ranges before it.
        ranged = materialize(both.repartitionByRange("k", "side").sortWithinPartitions("k", "side").withColumn("part", F.spark_partition_id()), "ranged")
        heads = ranged.groupBy("part").agg(F.max_by("shard", F.when(F.col("side") == 0, F.col("k"))).alias("last"))
        carried = heads.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        order = Window.partitionBy("part").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0)
        held = ranged.select("part", "k", "side", F.last("shard", ignorenulls=True).over(order).alias("shard")).join(carried, "part")
        found = held.where("side = 1").select(F.coalesce("shard", "carried").alias("shard"), F.col("k").alias("doc_id")).where("shard is not null")
    by_shard = found.repartition(_tasks(manifest), "shard").sortWithinPartitions("shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = None, None
        for batch in batches:
            rows = []
            for shard, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != at:
                    if reader:
                        reader.close()
                    reader, at = ShardReader(shard), shard
                if (ids := reader.get(doc_id)) is not None:
                    rows.append((doc_id, list(memoryview(ids).cast("I"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        if reader:
            reader.close()

    return by_shard.mapInArrow(work, "doc_id bigint, ids array<bigint>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents as shards in the shared folder and reads them back."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read(write(docs, tokenizer, shared_path(spark, "shards"), partitions))
