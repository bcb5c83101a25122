"""The corpus pipeline: quality, near copies, benchmark passages, personal data, then the mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``. In every stage null, empty and very long texts are rows like any other, extra
columns pass through under their names, whatever these are, repeated rows are told in the stage, and an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import decontamination, mixing, near_dedup, pii, quality
from talkmill.llm.common import forget, own_folder, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other; repeated rows go or stay together; a score that ties with the cut stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words to a shingle, similarity 0.8): that of the smallest doc_id.

    Null, empty and word-less texts have no copies and all stay; of repeated rows one stays; ties of the smallest doc_id
    fall to one row; groups without any doc_id keep a row each.
    """
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single passages are cut out of the others.

    Null and empty texts have no passages and stay; repeated rows fare alike; null and empty test items never occur.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds.

    Null texts stay null, texts without personal data as they are; repeated rows fare alike; of overlapping spans the first
    names the whole.
    """
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to equal weights, and rows shuffled.

    Null and unlisted sources keep the rate 1; a null doc_id draws by its text; repeated rows draw alike; ``copy_no`` is added
    (with underscores where the documents have one).
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
]

#: The first stage trains a network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(spark, stage(spark, docs, sf_dir), folder, f"{k}-{name}")
        if k:  # what the stage before wrote has been read
            forget(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
