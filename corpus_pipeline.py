"""The corpus pipeline: quality rules, language ID, near-dedup, decontamination and tokens, each over all that the
stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents. Rows
without an id and rows that repeat an id stay together in every stage; null texts go with the quality rules; texts of
any length are read whole; ties between copies go to the smallest id; an empty table passes through as an empty table.
Further columns of docs, whatever their names, are passed on by the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import bpe, decontamination, language_id, minhash_dedup, quality_rules
from prosegauge.llm.common import materialize, table
from prosegauge.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the current policy of the quality rules keeps."""
    return quality_rules.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that was learnt, with a score that mixed texts and other scripts don't reach;
    the model learns from the rows that are not held out."""
    return language_id.keep_known(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no test item stands."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of ids and decoded text."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("minhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: Language ID and the tokenizer can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
