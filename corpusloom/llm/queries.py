"""The operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    binary_records,
    byte_bpe,
    decontamination,
    language_id,
    lm_scoring,
    near_dedup,
    quality_rules,
    sharding,
    toxicity,
    url_filters,
)
from corpusloom.llm.common import read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return binary_records.token_records(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_sha256="decoded_sha256")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), url_filters.fit(url_filters.labelled_urls()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(read(spark, sf_dir, "documents"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.clusters(read(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = (
    op1_stupid_backoff,
    op2_quality_rules,
    op3_token_records,
    op4_byte_bpe,
    op5_url_filters,
    op6_language_id,
    op7_hash_tree_shards,
    op8_toxicity,
    op9_decontamination,
    op10_minhash_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_stupid_backoff": lm_scoring.ORACLE,
        "op5_url_filters": url_filters.oracle(url_filters.fit(url_filters.labelled_urls())),
        "op9_decontamination": decontamination.ORACLE,
    }
