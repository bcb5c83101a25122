"""The training-data queries registered with the driver, and the DuckDB SQL of those that SQL can express.

Without SQL are op2, op3 and op5 (trained models), op10 (spans of regular expressions) and the pipeline
(its first stage is a trained model); tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import class_lm, decontamination, licenses, mixing, near_dedup, pii, quality, secret_scan, vector_topk, warc
from .common import own_folder, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.digest(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.groups(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages"), own_folder(spark, "warc")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(
        decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op9_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.topk(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a ledger of its own: a run that shared one would scan only what it has not seen, which this is to measure whole."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), own_folder(spark, "ledger")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_pii": op2_pii,
    "op3_class_lm": op3_class_lm,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_vector_topk": op9_vector_topk,
    "op10_secret_scan": op10_secret_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op4_near_dedup": near_dedup.oracle(),
    "op6_mixing": mixing.oracle(),
    "op7_warc": warc.oracle(),
    "op8_decontamination": decontamination.oracle(),
    "op9_vector_topk": vector_topk.oracle(),
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
