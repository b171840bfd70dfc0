"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import annulus, byte_bpe, decontaminate, licenses, neardup, pii, posting_lists, quality, runs, substring_dedup, token_count, token_files, toxicity
from .frames import read


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(read(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(read(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.report(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.report(read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(read(spark, sf_dir, "documents"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.report(read(spark, sf_dir, "embeddings"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2."""
    return licenses.base_report(read(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6."""
    return pii.base_report(read(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9."""
    return quality.base_report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_licenses, op3_substring_dedup, op4_minhash, op5_token_count, op6_pii, op7_token_files, op8_byte_bpe, op9_quality, op10_decontaminate, op11_posting_lists, op12_periodic_runs, op13_annulus_clusters, license_base, pii_base, quality_base)}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": neardup.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL, "op13_annulus_clusters": annulus.ORACLE_SQL, "license_base": licenses.BASE_SQL, "pii_base": pii.BASE_SQL, "quality_base": quality.BASE_SQL}
