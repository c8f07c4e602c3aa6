"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to lower-case letters and digits with single spaces. An item may differ from a
passage by an error budget of k edits (one in EDIT_SHARE characters). Cut into k + 1 pieces, at least one piece of it
then stands in the passage unchanged: one Aho-Corasick automaton of all pieces finds these in a single pass over a
document, and Myers' bit-parallel distance, free to begin and end anywhere in the window around a hit, confirms.

The items are the stated query set. They are reduced in tasks, repeats go, and the rest is dealt by a hash of the text
into blocks of about BLOCK_CHARS characters, each a folder of one stored table. A task reads its documents in parts of
about HELD_BYTES of text and searches each part for one block after another: it loads a block from the shared folder,
builds its automaton, and lets it go before the next. So a task holds one part and one block however many blocks there
are, nothing of the benchmark passes through the driver, and with a single block (any benchmark of up to BLOCK_CHARS
characters) workers keep the automaton over all their tasks. Items of one text are searched for once; only their ids
are kept apart.

Cases: null and empty texts match nothing; items of fewer than SHORTEST reduced characters have no budget and match
whole words alone, as with edits they would match ordinary prose; items that keep no character match nothing; a null
doc_id stays null, items without an id are left out; repeated rows and items give repeated results and the item's
smallest id first; with no items, or an empty table, nothing is contaminated; other columns, whatever their names, are
ignored. Texts of any length are searched whole. Hits of one item that lie in one window are verified together.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialize, shared_path, small_parts

EDIT_SHARE = 25
SHORTEST = 30
BLOCK_CHARS = 2_000_000
#: Text that a task holds while it goes through the blocks, where there are several; one longer text is a part alone.
HELD_BYTES = 64 << 20
OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def reduced(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(pattern_bits: dict[str, int], length: int, window: str, budget: int) -> int:
    """Least edit distance of the pattern to any part of the window (Myers 1999); more than budget if none is near."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, length
    get = pattern_bits.get
    for c in window:
        eq = get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (~(d | plus) & full), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
                if best == 0:
                    return 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(x | up) & full), up & x
    return best


class Matcher:
    """One block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = SHORTEST) -> None:
        self.shortest = shortest
        ids: dict[str, list[int]] = {}
        for i, text in items:
            ids.setdefault(text, []).append(i)
        self.items = [(own, text, len(text) // EDIT_SHARE if len(text) >= shortest else 0) for text, own in ids.items()]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def _bits(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            self.bits[n] = table = {}
            for k, c in enumerate(self.items[n][1]):
                table[c] = table.get(c, 0) | 1 << k
        return self.bits[n]

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of the items that stand in a reduced text within their budgets."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text) if self.items else ():
            for n, at in where:
                _, item, budget = self.items[n]
                start = end - size + 1 - at
                if len(item) < self.shortest:
                    if (start and text[start - 1] != " ") or text[end + 1 : end + 2] not in ("", " "):
                        continue
                    windows[n] = [(start, end + 1)]
                    continue
                low, high = max(0, start - budget), start + len(item) + budget
                held = windows.setdefault(n, [])
                if held and low <= held[-1][1]:
                    held[-1] = (min(low, held[-1][0]), max(high, held[-1][1]))
                else:
                    held.append((low, high))
        found = []
        for n, held in windows.items():
            ids, item, budget = self.items[n]
            best = budget + 1
            for low, high in held:
                window = text[low:high]
                best = min(best, 0 if item in window else best_distance(self._bits(n), len(item), window, budget))
                if best == 0:
                    break
            if best <= budget:
                found.extend((i, best) for i in ids)
        return found


_held: list = []


def block_matcher(folder: str, shortest: int) -> Matcher:
    """The matcher of a stored block. A worker keeps the last one only, and lets it go before it builds another."""
    if not _held or _held[0] != (folder, shortest):
        _held.clear()
        system, path = fs.FileSystem.from_uri(folder)
        rows = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["item", "text"])
        _held.extend([(folder, shortest), Matcher(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist())), shortest)])
    return _held[1]


def search_parts(parts: list[pa.RecordBatch], folders: list[str], shortest: int) -> list[list[list[tuple[int, int]]]]:
    """For each row of each part (its second column is the text): (item, distance) of the items of all blocks."""
    texts = [[reduced(t.as_py()) if t.is_valid else "" for t in part.column(1)] for part in parts]
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in rows] for rows in texts]
    for folder in folders:
        search = block_matcher(folder, shortest).search
        for rows, hits in zip(texts, found):
            for text, hit in zip(rows, hits):
                hit.extend(search(text))
        del search  # so that this block goes before the next comes
    return found


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """The folders of the blocks of usable items: (item, text), reduced, without repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reduced(t.as_py()) for t in batch.column(1)], pa.string())], names=["item", "text"])

    rows = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null and item is not null")
    small = materialize(rows.mapInArrow(work, "item bigint, text string").where("text <> ''").distinct(), "items")
    total = small.select("text").distinct().agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    path = shared_path(items.sparkSession, "blocks")
    dealt = small.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
    dealt.repartition(min(n, 200), "block").write.partitionBy("block").parquet(path)
    used = dealt.select("block").distinct().orderBy("block").collect()
    return [f"{path}/block={r.block}" for r in used]


def match(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, distance) of each row of docs: the items that stand in it and the
    least distance. With carry, all columns of docs (in a struct `row`) in place of doc_id. shortest: items of fewer
    reduced characters match whole words exactly."""
    head = "row" if carry else "doc_id"
    first = F.struct(*docs.columns).alias("row") if carry else F.col(id_col).alias("doc_id")
    rows = docs.select(first, F.col(text_col).cast("string").alias("text"))
    schema = f"{head} {rows.schema[head].dataType.simpleString()}, found array<struct<item:bigint,distance:int>>"
    kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())]))
    folders, most = blocks(items), HELD_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, hits in zip(parts, search_parts(parts, folders, shortest)):
                found = pa.array([[{"item": i, "distance": d} for i, d in hit] for hit in hits], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=[head, "found"])

        held, size = [], 0
        for batch in batches:
            for part in small_parts(batch, 1):
                held.append(part)
                size += part.column(1).nbytes
                if len(folders) < 2 or size >= most:
                    yield from searched(held)
                    held, size = [], 0
        if held:
            yield from searched(held)

    rows = rows.mapInArrow(work, schema)
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x.getField("item"))))
    out = rows.select(head, F.coalesce(ids, F.array().cast("array<bigint>")).alias("item_ids"), F.array_min(F.transform("found", lambda x: x.getField("distance"))).alias("distance"))
    return out.select(head, (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distance")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item stands; all their columns."""
    return match(docs, items, carry=True).where(~F.col("contaminated")).select("row.*")
