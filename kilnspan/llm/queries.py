"""The thin queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, factors, hnsw, kneser_ney, mixing, rollup, simhash, suffix_dedup, toxicity, vafile
from .common import table

RANKS, OTHER_RANKS = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.removal_report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintained_counts(table(spark, sf_dir, "documents"), {name: public_tokenizers.path(name) for name in (RANKS, OTHER_RANKS)}, public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mixing, op3_embedding_dedup, op4_toxicity, op5_bpe, op6_exact_top_k, op7_token_counts, op8_quality, op9_suffix_dedup, op10_simhash)}
SQL = {"op1_substring_dedup": factors.SQL, "op3_embedding_dedup": hnsw.SQL, "op9_suffix_dedup": suffix_dedup.SQL, "op2_mixing": mixing.SQL, "op6_exact_top_k": vafile.SQL}
