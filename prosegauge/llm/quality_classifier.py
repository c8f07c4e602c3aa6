"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed block by block with a dictionary built from good labelled texts and again with one from bad
labelled texts. What it takes more with the bad one, as a share of its length, tells which kind it resembles; a
logistic curve fitted on labelled texts that built no dictionary turns that into a probability.

Dictionaries and curve come from at most SAMPLE labelled rows of each label, CHARS characters in PIECES pieces spread
over each; all of every text is scored. Of rows that repeat an id the least text is learnt from; an id with both labels
is learnt from as either.

Cases: null and empty texts get the score of a difference of 0; without rows of both labels every score is 0.5. A null
doc_id stays null and is not learnt from; repeated rows give repeated results; an empty table gives an empty result;
labels, lang, source and doc_id are never inputs of a score; other columns, whatever their names, are ignored. Texts of
any length are compressed block by block. A score of exactly 0.5 counts as label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import bounded_sample, id_bucket

SAMPLE, CHARS, PIECES = 1200, 8000, 8
BLOCK, DICTIONARY, LEVEL = 2048, 48 << 10, 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Measure:
    """The normalised difference of a text's sizes under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in map(self.dictionary, (good, bad))]

    @staticmethod
    def dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return d

    def difference(self, text: bytes) -> float:
        if not text:
            return 0.0
        blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self.packers)
        return (bad - good) / len(text)


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of zstandard's own trainer, or of plain content where the texts are too few for it."""
    samples = [t[at : at + 512] for t in texts for at in range(0, len(t), 512)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:] or b" "


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a slight pull to 0."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.column_stack((x / scale, np.ones_like(x)))
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, grad), -4, 4)
    return float(w[0] / scale), float(w[1])


def train(good: list[bytes], bad: list[bytes], share_good: float) -> Model | None:
    """Every other text builds a dictionary, the rest fit the curve; share_good is the share of label 1 overall."""
    if not good or not bad:
        return None
    halves = [(t[::2], t[1::2] or t) for t in (good, bad)]
    dictionaries = [build_dictionary(half[0]) for half in halves]
    measure = Measure(*dictionaries)
    x = [np.array([measure.difference(t) for t in half[1]]) for half in halves]
    y = np.concatenate((np.ones(len(x[0])), np.zeros(len(x[1]))))
    weight = np.concatenate((np.full(len(x[0]), share_good / len(x[0])), np.full(len(x[1]), (1 - share_good) / len(x[1])))) * len(y)
    return Model(*dictionaries, *calibrate(np.concatenate(x), y, weight))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Trains on rows that are not held out. The labels are sampled first, so that the documents meet a table of at
    most 2 * sample rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_bucket("doc_id", 3) != 1)).select("doc_id", "quality")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    picked = bounded_sample(known.where("quality = 1"), "doc_id", sample).union(bounded_sample(known.where("quality = 0"), "doc_id", sample)).distinct()
    size = CHARS // PIECES
    n = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring("text", (n * k / PIECES).cast("int") + 1, F.lit(size)))
    text = F.when(n <= CHARS, F.col("text")).otherwise(F.array_join(pieces, ""))
    named = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", text.alias("text"))
    # One text an id and label, however often the id repeats, so that the bound on the sample bounds what is collected.
    rows = named.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    kinds = [[r.text.encode() for r in rows if r.quality == q] for q in (1, 0)]
    return train(*kinds, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, difference) of every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([measure.difference(t.as_buffer().to_pybytes()) if measure and t.is_valid else 0.0 for t in part.column(1).cast(pa.large_binary())])
                z = x * model.slope + model.offset if model else x
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(x)], names=["doc_id", "score", "difference"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, difference double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents."""
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
