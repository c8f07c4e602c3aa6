"""The registered queries of the numbered operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import (
    bpe,
    decontamination,
    html_text,
    language_id,
    license_scan,
    minhash_dedup,
    personal_data,
    quality_classifier,
    quality_rules,
    ranked_search,
    spelling_variants,
    token_tables,
    warc,
)
from prosegauge.llm.common import table

#: A file of the public tokenizers, which lie at the same place on every machine.
TOKENIZER = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.contract(quality_rules.ledger(table(spark, sf_dir, "documents"))), quality_rules.OP9)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "policy", "kept")


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("shard")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_bpe": op3_bpe,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_html_text": op6_html_text,
        "op7_warc": op7_warc,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "op10_token_tables": op10_token_tables,
        "op11_ranked_search": op11_ranked_search,
        "op12_personal_data": op12_personal_data,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.sql(),
        "op4_minhash_dedup": minhash_dedup.sql(),
        "op7_warc": warc.sql(),
        "op9_quality_rules": quality_rules.sql(),
        "op11_ranked_search": ranked_search.sql(),
        "op13_spelling_variants": spelling_variants.sql(),
    }
