"""Text normalisation and lineage helpers shared by the training-data operators.

Working on UTF-8 bytes keeps the tokenisers exact and fast: ``bytes.lower`` folds A-Z only,
and ``bytes.split`` without arguments splits at the six ASCII blanks only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.sources.shared import forget, own_folder, qualified, shared_dir, size_of, stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes to bytes: A-Z to a-z; every other ASCII byte that is no letter or digit to a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    return whole_text(name).cast("binary")


def fold(name: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % n


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
