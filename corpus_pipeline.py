"""The corpus pipeline: documents through quality, language, near-duplicate and benchmark stages to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; a filtering stage returns documents with the columns it got, the last one returns the encoded rows.

Defined cases, for all stages: rows with null or empty text, or too few words, go in the first stage; a row with a null
id takes part in all stages but links with nothing; rows repeated whole are judged alike, and near-dedup keeps those of
the component's smallest id; an empty table gives no rows; columns may carry the names of operators' outputs and pass
through; whole texts are read however long they are; only texts travel to Python and only verdicts come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontamination, language_id, near_dedup, quality_rules
from corpusloom.llm.common import LIVE, Staged, discard_since, read
from corpusloom.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the base rule nor the isolation forest rejects."""
    return quality_rules.reject(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised with the calibrated certainty."""
    return language_id.accept(docs, language_id.fit(docs.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which less than a twentieth of the words are benchmark passages."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    coded = byte_bpe.encode(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_sha256="decoded_sha256")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: Three of the stages learn or hash what SQL can't; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    When a stage is written, what it staged on its way and what it read are removed.
    """
    docs, before = read(spark, sf_dir, "documents"), set(LIVE)
    for name, stage in STAGES:
        held = Staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard_since(spark, before, held.path)
        docs = held.df
    return docs
