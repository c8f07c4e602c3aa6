"""Spelling variants: words one insertion, deletion or replacement apart, and the more frequent form each one leans on.

Pivotal grams (Deng, Li and Feng 2014) find the pairs. Bigrams are ranked by how many places of the vocabulary hold
them. A word's *prefix* is its three rarest bigrams, with all places of the last of them; its *pivots* are two bigrams
of the prefix that share no character, picked by dynamic programming for the least sum of occurrences. One edit touches
one pivot at most, so of two near words the one whose prefix ends at the lower rank keeps a pivot that stands in the
other's prefix, at a place and length that the edit allows. The edit is on one side of that pivot, so all on the other
side, pivot included, is alike too: pivots are joined with prefixes by the length and a checksum of that side, which
tells place and bigram as well. The distance itself confirms what the join finds.

Occurrences are counted within tasks first, so a frequent word is a row a task. The one thing that is sent to all tasks
is the table of bigram ranks, which the alphabet bounds at 90 x 90 entries. Chains of forms at least double the count
with each step, so following them by doubling takes at most six rounds.

Cases: null, empty and wordless texts give no words; a document without an id counts with its runs as they stand;
repeated rows count each time; runs of any length are words; an empty table gives an empty result; other columns,
whatever their names, are ignored. Equal counts go to the word that is smaller in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialize

SHORTEST, FEWEST, ONE_IN = 5, 3, 97
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")
#: Words held by a task before it passes their counts on.
HELD = 300_000


def words_of(doc_id: str | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one document: one character is missing from each run whose checksum 97 divides."""
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        raw = run.encode().lower()  # of bytes, only A-Z have lower forms
        word = raw.decode()
        if start is not None and (h := zlib.crc32(raw, start)) % ONE_IN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= SHORTEST:
            yield word, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough occurrences."""

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                if text.is_valid:
                    for word, n in words_of(doc_id.as_py(), text.as_py()):
                        held[word] += n
                if len(held) > HELD:
                    yield flush(held)
                    held = Counter()
        yield flush(held)

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def gram_ranks(words: DataFrame) -> list[tuple[str, int]]:
    """(bigram, places), the rarest first. Bounded by the square of the alphabet."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("gram"))
    return [(r.gram, r.n) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()]


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Of (place, cost) in order of place, the indexes of two that are two places apart or more, at the least cost:
    the cheapest one that ends before each, then the cheapest pair."""
    best, pair, cheapest, seen = None, [], None, 0
    for k, (place, cost) in enumerate(prefix):
        while seen < k and prefix[seen][0] <= place - 2:
            if cheapest is None or prefix[seen][1] < prefix[cheapest][1]:
                cheapest = seen
            seen += 1
        if cheapest is not None and (best is None or prefix[cheapest][1] + cost < best):
            best, pair = prefix[cheapest][1] + cost, [cheapest, k]
    return pair


def halves(word: str) -> tuple[list[int], list[int]]:
    """Checksums of word[:k] and of word[k:] for each k, in one pass each way."""
    raw = word.encode("utf-16-le")  # two bytes a character
    ahead, behind = [0], [0]
    for k in range(0, len(raw), 2):
        ahead.append(zlib.crc32(raw[k : k + 2], ahead[-1]))
        behind.append(zlib.crc32(raw[len(raw) - k - 2 : len(raw) - k], behind[-1]))
    return ahead, behind[::-1]


def key(checksum: int, side: int, length: int) -> int:
    return checksum | side << 32 | length << 33


def signature(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """(rank at which the prefix ends, keys of the prefix, keys of the pivots). A key is a word's length with all up to
    a bigram, or all from it on; a pivot has one for each length that its partner may have."""
    grams = [(*ranks[word[k : k + 2]], k) for k in range(len(word) - 1)]
    last = sorted(r for r, _, _ in grams)[2]
    prefix = [(k, n) for r, n, k in grams if r <= last]
    ahead, behind = halves(word)
    keys = lambda at, size: [key(ahead[at + 2], 0, size), key(behind[at], 1, size)]
    held = [x for at, _ in prefix for x in keys(at, len(word))]
    asked = [x for i in pivots(prefix) for size in (len(word) - 1, len(word), len(word) + 1) for x in keys(prefix[i][0], size)]
    return last, held, asked


def signatures(words: DataFrame, ranked: list[tuple[str, int]]) -> DataFrame:
    """(word, n, last, held, asked) of each word."""
    ranks = {g: (k, n) for k, (g, n) in enumerate(ranked)}
    keys = pa.list_(pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, asked = zip(*(signature(w, ranks) for w in batch.column(0).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last, pa.int32()), pa.array(held, keys), pa.array(asked, keys)], names=["word", "n", "last", "held", "asked"])

    return words.select("word", "n").mapInArrow(work, "word string, n bigint, last int, held array<bigint>, asked array<bigint>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all pairs of words at distance 1. words: (word, n), read more than once."""
    signed = signatures(words, gram_ranks(words))
    ask = signed.select(F.explode("asked").alias("key"), F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("last").alias("x_last"))
    held = signed.select(F.explode("held").alias("key"), F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"))
    near = (F.col("x_last") <= F.col("y_last")) & (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1)
    found = ask.join(held, "key").where(near)
    first = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return found.select(pick("x", "y").alias("a"), pick("x_n", "y_n").alias("a_n"), pick("y", "x").alias("b"), pick("y_n", "x_n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms. forms: (word, form), without cycles."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(*(F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(n).alias("near_n")) for w, o, n in (("a", "b", "b_n"), ("b", "a", "a_n"))))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    leans = -F.col("top.less") >= 2 * F.col("n")
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leans, F.col("top.near")).alias("form"), F.when(leans, -F.col("top.less")).alias("form_n"))
    named = materialize(named, "forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """DuckDB SQL for `variants`: CRC-32 byte by byte, pairs by the texts that are left when one character goes."""
    return r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
codes AS (
  SELECT doc_id, run, n, list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS u FROM per),
bytes AS (
  SELECT doc_id, run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))) AS b FROM codes),
sums AS (
  SELECT doc_id, run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
made AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, i, length(word) AS len, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
named AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
follow AS (
  SELECT word, word AS root, 0 AS step FROM named
  UNION ALL SELECT f.word, m.form, f.step + 1 FROM follow f JOIN named m ON f.root = m.word WHERE m.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""
