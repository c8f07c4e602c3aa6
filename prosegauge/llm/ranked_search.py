"""Ranked lexical search by pipelined term partitioning.

Each term of the items has an owner, by how frequent it is. Bundles of items pass the owners one after the other, the
rarest terms first: at each, a bundle's sparse accumulators (document, score so far) meet the owner's postings in a
cogroup, whole numbers are added, and the bundle moves on. The last owner picks the best documents.

Documents are read once, into slices of at most SLICE documents; a slice's postings of one term are one row of packed
numbers, and bundle and slice are the key of all cogroups. So a term that every document holds is spread over all
slices, and a task holds one bundle's scores in one slice at a time. Only terms of items leave the scan: a bitmap of
FILTER_BITS hash values, whatever the number of items, lets few others through, and the join with the items' terms
drops these.

On the way an accumulator goes once it is hopeless: the 50th best score so far within the slice is a lower bound for
the item's 50th in the end, and what the owners ahead can add at most is known. All others are kept, so results are
exact.

Cases: null and wordless texts are in no statistics; rows without an id are left out, of documents and of items; rows
that repeat a doc_id are ranked each on its own; rows that repeat an item_id are one item with the terms of all; items
without terms, or whose terms no document holds, have no rows; with no documents or no items the result is empty;
other columns, whatever their names, are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import LOWER, UPPER, ascii_lower, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
#: Documents of a slice (their places fit two bytes), and items of a bundle.
SLICE, BUNDLE = 4096, 256
#: An owner's terms stand in at most one document in so many; the last one has the rest.
OWNERS = (64, 8, 1)
FILTER_BITS = 1 << 24
#: Pairs of term and bundle up to which the items' terms are sent to all tasks.
BROADCAST_PAIRS = 200_000
#: The most that a term of weight 1 adds to a score.
MOST = 1_000_000


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) of the items, once each."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), ascii_lower(F.col(text_col).cast("string")).alias("text")).where("item_id is not null")
    return rows.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).distinct()


def term_filter(terms: DataFrame) -> bytes:
    """The bitmap of the terms' hash values, FILTER_BITS bits."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)) + 1  # buckets begin at 1
    rows = terms.select(at.alias("at")).selectExpr("bitmap_bucket_number(at) AS bucket", "bitmap_bit_position(at) AS bit")
    bits = bytearray(FILTER_BITS // 8)
    for r in rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect():
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.map
    return bytes(bits)


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slice, term, n, size, a, b): for a term its documents' places in the slice and its occurrences in each, packed;
    for each slice one row without a term that has ids and numbers of terms of its documents, and the sum of these."""
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(terms))
    word = re.compile(TERM)
    schema = pa.schema([("slice", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def packed(name: str, ids: list[int], sizes: list[int], found: dict[str, list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = [(name, None, len(ids), sum(sizes), np.array(ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes())]
        for term, where in found.items():
            both = np.array(where, "<i8")
            rows.append((name, term, len(where), None, both[:, 0].astype("<u2").tobytes(), both[:, 1].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, task, number = shared.value, TaskContext.get().partitionId(), 0
        ids, sizes, found = [], [], {}
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                counts = Counter(word.findall(text.as_py().encode().lower().decode()))  # of bytes, only A-Z have lower forms
                if not counts:
                    continue
                place = len(ids)
                ids.append(doc_id.as_py())
                sizes.append(counts.total())
                for term, n in counts.items():
                    h = zlib.crc32(term.encode()) & (FILTER_BITS - 1)
                    if bits[h >> 3] >> (h & 7) & 1:
                        found.setdefault(term, []).append((place, n))
                if len(ids) == SLICE:
                    yield packed(f"{task}-{number}", ids, sizes, found)
                    ids, sizes, found, number = [], [], {}, number + 1
        if ids:
            yield packed(f"{task}-{number}", ids, sizes, found)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(work, "slice string, term string, n bigint, size bigint, a binary, b binary")


def plan_of_terms(asked: DataFrame, held: DataFrame, n: int, bundles: int) -> DataFrame:
    """(owner, bundle, term, w, items): each owner's terms with their weights, and the items of a bundle that ask for
    them, each with the most that the owners ahead can add to it."""
    df = held.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = sum((F.when(F.col("df") * part > n, 1).otherwise(0) for part in OWNERS[:-1]), F.lit(0))
    weighed = asked.join(df, "term").select("item_id", "term", weight.alias("w"), owner.cast("int").alias("owner")).where("w > 0")
    by_item = weighed.groupBy("item_id").agg(*(F.coalesce(F.sum(F.when(F.col("owner") > k, F.col("w"))), F.lit(0)).alias(f"r{k}") for k in range(len(OWNERS))))
    rest = F.element_at(F.array(*(F.col(f"r{k}") for k in range(len(OWNERS)))), F.col("owner") + 1) * MOST
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int")
    return weighed.join(by_item, "item_id").groupBy("owner", bundle.alias("bundle"), "term", "w").agg(F.collect_list(F.struct("item_id", rest.alias("rest"))).alias("items"))


def _owner_work(n: int, total: int, last: bool):  # noqa: ANN202
    """One owner's work on one bundle in one slice: adds its postings to the accumulators. The last owner gives the
    best documents, all others the accumulators that are not hopeless."""
    names = ["item_id", "doc_id", "score"] if last else ["bundle", "slice", "item_id", "docs", "scores"]

    def work(key: tuple, carried: pa.Table, owned: pa.Table) -> pa.Table:
        rows = owned.to_pylist()
        page = next((r for r in rows if r["term"] is None), None)
        terms = [r for r in rows if r["term"] is not None]
        ids = np.frombuffer(page["a"], "<i8")
        m = 50 + 50 * np.frombuffer(page["b"], "<i8") * n // total
        rests = {i["item_id"]: i["rest"] for r in terms for i in r["items"]}
        come = {r["item_id"]: r for r in carried.to_pylist()}
        order = sorted({*rests, *come})
        index = {item: k for k, item in enumerate(order)}
        scores = np.zeros((len(order), len(ids)), np.int64)
        for item, r in come.items():
            scores[index[item], np.frombuffer(r["docs"], "<u2")] = np.frombuffer(r["scores"], "<i8")
        for r in terms:
            at, tf = np.frombuffer(r["a"], "<u2"), np.frombuffer(r["b"], "<i8")
            scores[np.ix_([index[i["item_id"]] for i in r["items"]], at)] += r["w"] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
        out = []
        for item, k in index.items():
            row = scores[k]
            at = np.flatnonzero(row)
            if last:
                at = at[np.lexsort((ids[at], -row[at]))][:BEST]
                out += [(item, int(d), int(s)) for d, s in zip(ids[at], row[at])]
                continue
            if item in rests and len(at) > BEST:
                floor = np.partition(row[at], len(at) - BEST)[len(at) - BEST]
                at = at[row[at] + rests[item] >= floor]
            if len(at):
                out.append((key[0].as_py(), key[1].as_py(), item, at.astype("<u2").tobytes(), row[at].tobytes()))
        kinds = [pa.int64()] * 3 if last else [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=names)

    return work


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the BEST highest scores above 0 of each item over all documents."""
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_col), "asked")
    held = materialize(postings(docs, asked.select("term").distinct(), id_col, text_col), "postings")
    pages = held.where("term is null")
    n, total = (x or 0 for x in pages.agg(F.sum("n"), F.sum("size")).first())
    bundles = -(-asked.agg(F.countDistinct("item_id")).first()[0] // BUNDLE) or 1
    plan = materialize(plan_of_terms(asked, held, n, bundles), "terms")
    small = plan.count() <= BROADCAST_PAIRS
    carried = spark.createDataFrame([], "bundle int, slice string, item_id bigint, docs binary, scores binary")
    none = F.array().cast("array<struct<item_id:bigint,rest:bigint>>")
    every = pages.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "slice", "term", F.lit(0).cast("bigint").alias("w"), none.alias("items"), "a", "b")
    for k in range(len(OWNERS)):
        last = k == len(OWNERS) - 1
        own = plan.where(F.col("owner") == k).select("bundle", "term", "w", "items")
        mine = held.where("term is not null").join(F.broadcast(own) if small else own, "term").select("bundle", "slice", "term", "w", "items", "a", "b")
        schema = "item_id bigint, doc_id bigint, score bigint" if last else carried.schema
        carried = carried.groupBy("bundle", "slice").cogroup(mine.unionByName(every).groupBy("bundle", "slice")).applyInArrow(_owner_work(n, total, last), schema)
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return carried.where("score > 0").withColumn("rank", best).where(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def sql() -> str:
    """DuckDB SQL for `search` over documents and benchmark."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))"
    return f"""
WITH asked AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tokens AS (SELECT row, doc_id, {terms} AS term FROM numbered),
counts AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
facts AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS total FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM counts, facts WHERE term IN (SELECT term FROM asked) GROUP BY term, big_n),
lengths AS (SELECT row, 50 + ((50 * n * big_n) // total) AS m FROM sizes, facts),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
