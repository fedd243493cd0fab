"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import langid, lattice, linecrf, lines, mixing, neardup, packing, quality, secretscan, suffix
from tempograph.llm.common import small_batches


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(spark, _read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(spark, docs))


def op6_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_read(spark, sf_dir, "documents"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(spark, _read(spark, sf_dir, "documents"))


def op9_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return linecrf.label_lines(docs, linecrf.train(spark, docs, _read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicates(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_suffix_array_dedup, op2_quality_classifier, op3_harmonic_packing, op4_soft_mixing, op5_language_id, op6_lattice_near_duplicates, op7_secret_scan, op8_simhash_near_duplicates, op9_line_labelling, op10_line_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_harmonic_packing": packing.pack_sql()}
