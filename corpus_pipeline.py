"""The corpus pipeline: quality rules, language ID, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns of documents as they came; a null in any column, repeated
rows, empty tables and further columns of any name are handled as the operators'
docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parley.llm.bpe import bpe_round_trip
from parley.llm.common import staged
from parley.llm.language_id import keep_identified
from parley.llm.mixing import mix
from parley.llm.near_copies import keep_one
from parley.llm.quality_rules import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality, by rules' votes, is enough."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at five-word Jaccard similarity 0.8 or more: SimHash and MinHash propose, exact similarity decides."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the digests of each document's ids and of their decoded text."""
    found = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return found.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("language_id", language), ("simhash_dedup", near_duplicates), ("mixing", mixing), ("bpe", encoding)]

#: Compression, fingerprints and merging have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
