"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

1. `sketches`: each document's set of five-word shingles, as sorted 64-bit hashes, gives a key and a signature.
   Documents with equal sets form one class, whose smallest id stands for it from here on.
2. `super_minhash`: SuperMinHash (Ertl 2017): in step j an element draws a value in [j, j + 1) and, by the next swap of a
   permutation of its own, a slot; a slot keeps its least value. The ranks of one element are a permutation, so slots
   share out the elements evenly and estimates vary less. Once each slot holds a value below j, later steps cannot
   lower any of them, and the document stops early.
3. `links`: classes that agree on all rows of a band meet in a bucket. Each member is paired with the bucket's hub, the
   member with the most company over all its buckets, as the original of a group of copies has. Members of a bucket
   that are in different components after that are compared by sizes and digests of the signatures where they meet, so
   that only pairs that may well be similar go on: buckets of up to SMALL members in a join, larger ones in cells of a
   grid, whose members' digests are compared in Arrow batches, bit by bit for all slots at once (`_near_in_cell`).
4. `verify`: 100 * intersection >= `similar` * union on the full sets.
5. `components`: union-find inside each partition contracts the links, then rounds of the large-star and small-star
   rules join what the partitions hold, until nothing changes.

Bands and allowed differences of digests follow from the threshold. A pair at the threshold shares no bucket with
probability below 1e-7 (28 bands of 5 rows at 0.85, 41 at 0.8); its digests differ too much with probability below
1e-6. More similar pairs are missed more rarely still.

Cases: null or empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer
than five words is one shingle. A null id is its own component (null) and never kept; rows that repeat an id count as
one node, so they share the component of the id. Ties go to the smaller id. An empty table gives an empty result.
Other columns of the input, whatever their names, are ignored. Very long texts are taken whole: a sketch holds one
text's shingles at a time besides its batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialize

#: SIMILAR is the threshold of op4, STAGE_SIMILAR that of the pipeline's stage.
SHINGLE, SIMILAR, STAGE_SIMILAR = 5, 85, 80
ROWS = 5
#: Slots of a signature; the bands take the first of them, digests take all.
SLOTS = 384
#: Probability with which a pair at the threshold may share no band.
MISSED = 1e-7
#: Members of a bucket that meet in a plain join; larger buckets are compared in cells of twice CELL members at most.
SMALL = 64
CELL = 8000
#: Edges that one task contracts; components of fewer need no rounds between tasks.
TASK_EDGES = 500_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a fixed permutation of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2 ** 64, kept for the next call."""
    if len(_powers[k]) < n:
        p = np.full(2 * n, base % (1 << 64), np.uint64)
        p[0] = 1
        _powers[k] = np.multiply.accumulate(p)
    return _powers[k][:n]


def text_shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Words are hashed from prefix sums over all bytes at once."""
    data = _lower[np.frombuffer(raw, np.uint8)]
    gap = np.concatenate(([True], _space[data], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_value[data] * _power(0, _BASE, len(data)), out=sums[1:])
    words = mix((sums[end] - sums[start]) * _power(1, _INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = mix(out * U(_BASE) + words[k : k + n])
    return np.unique(out).view(np.int64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    return [text_shingles(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.int64) for x in texts.cast(pa.large_binary())]


#: Steps whose swaps are followed back one by one; after them the few elements left get whole permutations.
FIRST_STEPS = 6


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` values for each set. All sets of a batch take a step together; a set that can't change any
    more leaves."""
    least = np.full((len(sets), slots), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []  # of step i: the place that place i changed with
    order = None
    for j in range(slots):
        if not len(element):
            break
        draw = mix(element + U((2 * j + 1) * _BASE % (1 << 64)))
        value = j + (draw >> U(11)).astype(np.float64) * 2.0**-53
        target = j + (mix(draw ^ U(_BASE)) % U(slots - j)).astype(np.int64)
        if order is None:
            place = target.copy()
            for i in range(j - 1, -1, -1):
                place = np.where(place == i, swaps[i], np.where(place == swaps[i], i, place))
        else:
            row = np.arange(len(element))
            place = order[row, target]
            order[row, target] = order[:, j]
        np.minimum.at(flat, owner * slots + place, value)
        stay = (least.max(axis=1) >= j + 1)[owner]
        swaps.append(target)
        if not stay.all():
            element, owner, swaps = element[stay], owner[stay], [s[stay] for s in swaps]
            order = order[stay] if order is not None else None
        if j + 1 == FIRST_STEPS:
            row, order = np.arange(len(element)), np.tile(np.arange(slots, dtype=np.int16), (len(element), 1))
            for i, s in enumerate(swaps):
                order[row, s], order[:, i] = order[:, i].copy(), order[row, s]
            swaps = []
        elif order is not None:
            swaps = []
    return least


#: Bits of each slot that a digest keeps.
DIGEST_BITS = 4


def bands_of(similar: int) -> int:
    """Bands that leave a pair at the threshold without a common bucket with probability MISSED at most."""
    bands = math.ceil(math.log(MISSED) / math.log(1 - (similar / 100) ** ROWS))
    if bands * ROWS > SLOTS:
        raise ValueError(f"similarity {similar} takes {bands} bands of {ROWS} rows, more than {SLOTS} slots hold")
    return bands


def different(similar: int) -> int:
    """Slots in which two digests may differ: the mean at the threshold and five deviations more (54 and 5 * 6.8 at
    0.85; the deviation is less for sets of a few hundred shingles)."""
    share = (1 - similar / 100) * (1 - 2.0**-DIGEST_BITS)
    return int(SLOTS * share + 5 * math.sqrt(SLOTS * share * (1 - share)))


def _digests(least: np.ndarray) -> np.ndarray:
    """A few bits of every slot, sixteen slots in a long."""
    words = -(-SLOTS // 16)
    bits = np.zeros((len(least), words * 16), np.uint64)
    bits[:, :SLOTS] = mix(least.view(np.uint64)) & U((1 << DIGEST_BITS) - 1)
    shifts = np.arange(0, 64, DIGEST_BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(bits.reshape(len(least), words, 16) << shifts, axis=2).view(np.int64)


def _near_digests(a: str, b: str, similar: int) -> Column:
    """Whether two digests (arrays of long) differ in few enough slots."""
    total = F.lit(0)
    for k in range(-(-SLOTS // 16)):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total <= different(similar)


def _planes(digests: np.ndarray) -> np.ndarray:
    """(bits, words, rows): bit b of all slots of a digest, 64 slots in a word. Slots differ where any plane differs."""
    n = len(digests)
    slots = (digests.view(np.uint64)[:, :, None] >> np.arange(0, 64, DIGEST_BITS, dtype=np.uint64)).astype(np.uint8).reshape(n, -1)
    packed = [np.packbits(slots >> b & 1, axis=1) for b in range(DIGEST_BITS)]
    packed = [np.pad(p, ((0, 0), (0, -p.shape[1] % 8))) for p in packed]
    return np.ascontiguousarray(np.stack([np.ascontiguousarray(p).view(np.uint64).T for p in packed]))


def _near_in_cell(cell: pa.Table, similar: int) -> pa.Table:
    """Pairs (a, b) of one cell, of members of different components whose sizes and digests are near and whose first
    common band this is. Members are in order of size, so each meets only the range of sizes that it can be similar to;
    a few thousand comparisons are made at once, in memory of a few MB."""
    col = lambda name: cell.column(name).combine_chunks()
    wide = lambda name: col(name).flatten().to_numpy().reshape(cell.num_rows, -1)
    size = col("size").to_numpy()
    order = np.argsort(size, kind="stable")
    size, part = size[order], col("part").to_numpy()[order]
    # Ids may be of any type: components are compared by their places in a dictionary.
    nodes, components = col("node").take(pa.array(order)), col("component").take(pa.array(order)).dictionary_encode().indices.to_numpy()
    bands, planes, here = wide("bands")[order], _planes(wide("digest")[order]), col("band")[0].as_py()
    diagonal = cell.column("lo")[0].as_py() == cell.column("hi")[0].as_py()
    left, right = (np.arange(len(size)),) * 2 if diagonal else (np.flatnonzero(part == cell.column(k)[0].as_py()) for k in ("lo", "hi"))
    if not len(left) or not len(right):
        left, right = left[:0], right[:0]
    other, sizes = np.ascontiguousarray(planes[:, :, right]), size[right]
    one, two, limit = [], [], different(similar)
    step = max(1, 100_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        low = np.searchsorted(sizes, -(-similar * size[rows[0]] // 100), "left")
        high = np.searchsorted(sizes, 100 * size[rows[-1]] // similar, "right")
        if low >= high:
            continue
        total = np.zeros((len(rows), high - low), np.uint16)
        for w in range(planes.shape[1]):
            unlike = planes[0, w, rows, None] ^ other[0, w, None, low:high]
            for b in range(1, DIGEST_BITS):
                unlike |= planes[b, w, rows, None] ^ other[b, w, None, low:high]
            total += np.bitwise_count(unlike)
        i, j = np.nonzero(total <= limit)
        i, j = rows[i], right[low + j]
        fits = (components[i] != components[j]) & (100 * size[i] >= similar * size[j]) & (100 * size[j] >= similar * size[i])
        if diagonal:
            fits &= i < j
        i, j = i[fits], j[fits]
        common = bands[i] == bands[j]
        mine = bands[i, common.argmax(axis=1)] == here
        one.append(i[mine])
        two.append(j[mine])
    empty = np.zeros(0, np.int64)
    return pa.table({"node": nodes.take(pa.array(np.concatenate([empty, *one]))), "node2": nodes.take(pa.array(np.concatenate([empty, *two])))})


def _band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    bits = least[:, : bands * ROWS].copy().view(np.uint64).reshape(len(least), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(_BASE), (len(least), bands))
    for r in range(ROWS):
        key = mix(key * U(_BASE) + bits[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, set_key, n_shingles, bands, digest) of the rows with an id. set_key is equal for equal sets; bands are
    the keys of the buckets. The sets themselves are not kept: they would outweigh the texts."""
    bands = bands_of(similar)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                set_keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                least = super_minhash(sets)
                rows = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1))) for m in (_band_keys(least, bands), _digests(least))]
                yield pa.RecordBatch.from_arrays([part.column(0), set_keys, sizes, *rows], names=["doc_id", "set_key", "n_shingles", "bands", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return named.mapInArrow(work, f"doc_id {kind}, set_key binary, n_shingles bigint, bands array<bigint>, digest array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; texts has (node, text). Both joins are inner joins of stored
    tables, so that Spark can split the key of a hub with many partners."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}

        def sets(x: pa.Scalar) -> np.ndarray:
            raw = x.as_buffer().to_pybytes()
            if raw not in recent:
                if len(recent) >= 64:
                    recent.pop(next(iter(recent)))
                recent[raw] = text_shingles(raw)
            return recent[raw]

        for batch in batches:
            linked = []
            for s, t in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())):
                x, y = sets(s), sets(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= similar * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return two.select("a", "b", "s", "t").mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _contract(edges: DataFrame) -> DataFrame:
    """Union-find over each partition's own edges: as many edges at most as the partition has nodes, all to a root."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for frame in frames:
            for a, b in zip(frame.a.tolist(), frame.b.tolist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}).query("a != b")

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInPandas(work, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches; both columns of one type.

    Each round lets all larger neighbours of a node, and then the node with all its smaller ones, point at the least
    of them. Neighbours are joined with an aggregate, never collected.
    """
    edges = materialize(_contract(edges.where("a <> b")), "edges")
    tasks = -(-edges.count() // TASK_EDGES)
    if tasks <= 1 or tasks < edges.rdd.getNumPartitions():
        edges = materialize(_contract(edges.coalesce(max(1, tasks))), "edges")
    while tasks > 1:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        after = materialize(_contract(small.distinct()), "edges")
        # A star forest: each node points at a root, and no root points anywhere.
        tangled = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = after.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y").limit(1).count()
        edges = after
        if not tangled and not twice:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links(nodes: DataFrame, docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links (a, b) between classes that connect the same nodes as all links do; nodes has (node, n_shingles, bands, digest)
    and docs (node, text)."""
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    buckets = materialize(buckets, "buckets")
    crowd = materialize(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "crowd")
    buckets = materialize(buckets.join(crowd, "band"), "buckets")
    company = materialize(buckets.groupBy("node").agg(F.sum("n").alias("company")), "company")
    buckets = materialize(buckets.join(company, "node").select("band", "node", "company"), "buckets")
    sizes = nodes.select("node", F.col("n_shingles").alias("size"), "digest", "bands")
    texts = materialize(docs.join(company.select("node"), "node", "left_semi"), "texts")
    hubs = buckets.groupBy("band").agg(F.max(F.struct("company", F.negate("node").alias("node"))).alias("hub"))
    hubs = materialize(hubs.select("band", F.negate("hub.node").alias("hub")), "hubs")
    pairs = buckets.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    done = materialize(pairs, "pairs")
    found = materialize(verify(done, texts, similar), "links")
    # Hubs have met all of their buckets; the rest of a bucket counts on only if it spans several components.
    rest = buckets.join(hubs, (buckets.band == hubs.band) & (buckets.node == hubs.hub), "left_anti")
    groups = materialize(components(found), "groups")
    named = materialize(rest.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "rest")
    open_bands = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    named = named.join(materialize(open_bands, "open"), "band").select("band", "node", "component")
    # What is left: members of one bucket in different components that no hub linked. Sizes and digests rule most pairs
    # out where the rows meet, so only pairs that may well be similar leave the join.
    named = materialize(named.join(sizes, "node"), "left")
    pairs = apart(named, similar).distinct().join(done, ["a", "b"], "left_anti")
    return found.union(verify(materialize(pairs, "pairs"), texts, similar))


def apart(named: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket that are in different components and may well be similar; named has
    (band, node, component, size, digest, bands).

    A bucket of more than SMALL members falls into g parts of about CELL by a hash of its members, and the pairs of two
    parts (or of one) meet in a cell of their own: g * (g + 1) / 2 groups, none of them larger than two parts."""
    crowd = named.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > SMALL)
    large = materialize(crowd.select("band", F.ceil(F.col("n") / CELL).cast("int").alias("g")), "large")
    few = named.join(large, "band", "left_anti")
    two = few.select(F.col("band").alias("band2"), *(F.col(c).alias(f"{c}2") for c in ("node", "component", "size", "digest", "bands")))
    # Once a pair: in the first band that it shares.
    first = F.get(F.array_intersect("bands", "bands2"), F.lit(0)) == F.col("band")
    near = (100 * F.col("size") >= similar * F.col("size2")) & (100 * F.col("size2") >= similar * F.col("size")) & _near_digests("digest", "digest2", similar)
    meets = (F.col("band") == F.col("band2")) & (F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2"))
    met = few.join(two, meets & near & first).select("node", "node2")
    dealt = named.join(large, "band").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("g")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = dealt.select("band", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "node", "component", "size", "digest", "bands")
    kind = named.schema["node"].dataType.simpleString()
    grid = cells.groupBy("band", "lo", "hi").applyInArrow(lambda cell: _near_in_cell(cell, similar), f"node {kind}, node2 {kind}")
    return met.union(grid).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs with an id or without."""
    sketch = materialize(sketches(docs, id_col, text_col, similar), "sketches")
    some = sketch.where("n_shingles > 0")
    first = F.min(F.struct("doc_id", "n_shingles", "bands", "digest")).alias("first")
    classes = materialize(some.groupBy("set_key").agg(first).select("set_key", F.col("first.doc_id").alias("node"), "first.n_shingles", "first.bands", "first.digest"), "classes")
    named = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text")).where("node is not null and text is not null")
    found = links(classes.select("node", "n_shingles", "bands", "digest"), named, similar)
    # An id that stands in two classes (rows that repeat it with other texts) ties the classes together.
    member = some.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    tied = member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = components(found.union(tied.select("a", "b")))
    ids = sketch.select("doc_id", "n_shingles")
    known = ids.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    out = known.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    null = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("doc_id"), F.lit(None).cast("bigint").alias("n_shingles"), F.col(id_col).alias("component_id"), F.lit(False).alias("kept"))
    return out.union(null)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = STAGE_SIMILAR) -> DataFrame:
    """The rows of docs that are the first of their group; rows without an id stay, as they are in no group."""
    kept = dedup(docs, id_col, text_col, similar).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").select(docs.columns).union(docs.where(F.col(id_col).isNull()))


def sql() -> str:
    """DuckDB SQL for the rows of op4: all pairs that share a shingle, then reachability."""
    return r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingles from d),
c as (select shingles_key, min(doc_id) as node, any_value(shingles) as shingles from (select *, list_sort(shingles) as shingles_key from s where len(shingles) > 0) group by shingles_key),
e as (select node, len(shingles) as n, unnest(shingles) as x from c),
p as (select a.node as a, b.node as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common from e a join e b on a.x = b.x and a.node < b.node group by a.node, b.node),
l as (select a, b from p where 100 * common >= 85 * (n + m - common)),
u as (select a, b from l union all select b, a from l),
r as (select node as a, node as b from c union select r.a, u.b from r join u on r.b = u.a),
g as (select a as node, min(b) as component from r group by a),
k as (select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(g.component, s.doc_id) as component_id
  from s left join c on list_sort(s.shingles) = c.shingles_key left join g on g.node = c.node)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from k"""
