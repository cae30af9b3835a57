"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

    quality     documents that the weakly trained classifier rejects go
    exact       of equal texts the one with the largest doc_id stays
    near        of each class of near copies (5-word shingles, 0.8) the smallest doc_id stays
    benchmark   documents that hold a whole window (8 words) of any benchmark item go
    encode      every text as byte-level BPE ids: doc_id, n_tokens and digests

All stages but the last return the columns of documents.

Null and empty texts are rejected by the first stage, which keeps nothing without
words. Given to the others, they count as one empty text (exact), as classes of
their own (near), as clean (benchmark) and as no tokens (encode). Null ids stay
like others; in exact and near a row with an id is kept before one without. Rows
repeated with one id and text are one document after exact and near. Ties go by
id, as each stage says. Empty tables give empty tables. Texts of any length are
read whole, and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowsql.llm import bpe, decontam, exact_dedup, jaccard, quality
from sparrowsql.llm.common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("encode", encode_stage),
]

#: A trained classifier and a tokenizer can't be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
