"""Secret scan over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet
folder, partitioned by rule version, with one row per blob that was scanned under that version;
a run scans only (blob, rule version) pairs that it lacks, appends them and joins findings back to
all paths. Copies are scanned once: blobs are deduplicated before texts meet, on the map side too,
and only texts that hold some rule's anchor (a necessary part of every match) are moved at all;
the others enter the ledger with no findings.

Defined cases: a null text is the empty blob, without findings; every row of the input gets one
result row, repeated rows equal ones; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text

#: Raised with every change of RULES or of their checks.
RULE_VERSION = 1

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least length, group that the length is of. Kinds stand in the order in which spans of one start are listed.
BASE = (("assign", _ASSIGN, 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]{16,}", 16, 0))
#: What the scan finds beyond the base kinds: formats that their issuers document.
MORE = (
    ("github", r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{36,}", 36, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20, 0),
    ("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}", 15, 0),
)
RULES = BASE + MORE
#: Some part of this is in every match of any rule.
ANCHOR = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}|gh[pousr]_|github_pat_|eyJ|-----BEGIN|xox"

FINDINGS = "array<struct<kind: string, start: bigint, end: bigint>>"
LEDGER = f"blob string, findings {FINDINGS}"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_COMPILED = [(kind, re.compile(p, re.ASCII), least, group) for kind, p, least, group in RULES]


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed."""
    out = []
    for order, (kind, pattern, least, group) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py())] if t.is_valid else [] for t in batch["text"]
        ]
        yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(found, _ARROW)], names=["blob", "findings"])


def _versions(docs: DataFrame, text: str) -> Column:
    return F.sha2(whole_text(text).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str, rule_version: int) -> DataFrame | None:
    """The blobs scanned under this version, or None before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/rule_version={rule_version}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def update(docs: DataFrame, ledger: str, text: str = "text", rule_version: int = RULE_VERSION) -> None:
    """Scans the blobs that the ledger lacks and appends them."""
    spark = docs.sparkSession
    whole = whole_text(text)
    blobs = docs.select(_versions(docs, text).alias("blob"), F.when(whole.rlike(ANCHOR), whole).alias("text"))
    unseen = blobs.dropDuplicates(["blob"])
    if (seen := read_ledger(spark, ledger, rule_version)) is not None:
        unseen = unseen.join(seen.select("blob"), "blob", "left_anti")
    unseen.mapInArrow(_scan, LEDGER).write.mode("append").parquet(f"{ledger}/rule_version={rule_version}")


def scan(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """path, blob and findings of every row; only what is unseen is scanned."""
    update(docs, ledger, text, rule_version)
    known = read_ledger(docs.sparkSession, ledger, rule_version)
    if known is None:  # nothing was ever scanned
        known = docs.sparkSession.createDataFrame([], LEDGER)
    # Two runs at once may both append a blob, with the same findings. Blobs without findings need no partner. Written,
    # the findings are a plain side of the join, so Spark can split the rows of a blob with very many paths.
    known = known.filter(F.size("findings") > 0).dropDuplicates(["blob"])
    known = stored(docs.sparkSession, known, f"{ledger}-joins", uuid.uuid4().hex)
    return docs.select(F.col(path), _versions(docs, text).alias("blob")).join(known, "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    spans = F.coalesce("findings", F.array().cast(FINDINGS))
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = F.filter(spans, lambda s: s["kind"].isin([k for k, *_ in BASE]))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k, *_ in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
