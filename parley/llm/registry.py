"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import token_alignment
from .bpe import bpe_round_trip
from .common import documents
from .flac import flac_round_trip
from .hard_negatives import ORACLE as NEGATIVES_ORACLE
from .hard_negatives import hard_negatives, relabelled
from .language_id import language_id
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .mixing import mixing_weights
from .mixing import oracle as mixing_oracle
from .packing import packed_documents
from .quality_rules import oracle as quality_oracle
from .quality_rules import quality_rules
from .simhash import simhash_components
from .token_counts import token_counts
from .url_rules import ORACLE as URL_ORACLE
from .url_rules import rule_table, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_weights(documents(spark, sf_dir))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), rounds=2, whole_words=True)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_round_trip(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, relabelled(vectors))


_ALL = (
    op1_token_counts,
    op2_mixing,
    op3_bpe_round_trip,
    op4_license_scan,
    op5_lm_scoring,
    op6_url_rules,
    op7_simhash,
    op8_language_id,
    op9_flac,
    op10_quality_rules,
    op11_token_alignment,
    op12_packing,
    op13_hard_negatives,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing_oracle(),
    "op6_url_rules": URL_ORACLE,
    "op10_quality_rules": quality_oracle(),
    "op13_hard_negatives": NEGATIVES_ORACLE,
}
