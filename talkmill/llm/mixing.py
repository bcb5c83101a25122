"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source with n of the N rows of all listed sources and the share w of their summed weights gets the
mean rate w * N / n. Each document draws its count from the Poisson distribution of its source's rate,
by inversion of a uniform number that md5 makes of the seed and the document; so the draw depends on
nothing else and repeats exactly. Documents are exploded by their counts and dealt out by a hash of
document, copy and row, in the order of the first two in each partition.

Inversion steps through the distribution, so a rate above ``PART`` is split: a sum of independent Poisson counts is
a Poisson count of the summed rate. Such a document becomes so many parts, which are dealt out, and each draws on
its own. So a document that stands for very many is not exploded in one task, and the plan is the same at any rate.

Only the listed sources (a parameter, ``MAX_SOURCES`` at most) reach the driver, as one count each, and their rates
are broadcast. Nothing is grouped by source afterwards, so a hot source is no hot key.

Defined cases: sources that are not listed, and null ones, keep the rate ``other``; a null doc_id
draws by its text, a null text as an empty one; repeated rows draw alike; very long texts are copied whole; a source
of weight 0 disappears; an empty table gives no rows. All columns stay, whatever they are called: where the documents
have a ``copy_no``, in any case, the new one gets underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Equal weights of the twenty sources of the corpus.
TARGETS = {f"src{i}": 1.0 for i in range(20)}
MAX_SOURCES = 10_000
SEED = "mix-1"
#: Largest rate of one draw, and a number that no draw of it reaches.
PART, MOST = 32.0, 1024
_DIGITS = 13  # hexadecimal digits of a uniform number: 52 bits


def inverted(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u, for a rate of at most ``PART``."""
    steps = (rate + F.sqrt(rate) * 12 + 40).cast("int")
    zero = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct((acc["n"] + (acc["s"] <= u).cast("int")).alias("n"), p.alias("p"), (acc["s"] + p).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda acc: acc["n"])


def identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a document is drawn by: its id, or without one its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def uniform(key: Column) -> Column:
    bits = F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0 ** (4 * _DIGITS))


def rates(docs: DataFrame, targets: dict[str, float], total: float = 1.0) -> dict[str, float]:
    """Mean repetitions by listed source; ``total`` is the size of their mixture by that of their rows."""
    if len(targets) > MAX_SOURCES or any(w < 0 for w in targets.values()):
        raise ValueError(f"at most {MAX_SOURCES} sources with weights of 0 or more are expected")
    rows = docs.select(F.col("source").cast("string").alias("s")).filter(F.col("s").isin(list(targets))).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in rows}
    weights = sum(targets[s] for s in n)
    if not weights:
        return dict.fromkeys(n, 0.0)
    return {s: targets[s] / weights * sum(n.values()) * total / c for s, c in n.items()}


def mix(docs: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, other: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents' columns and copy_no, each document as often as it was drawn.

    copy_no counts a document's copies from 1; where its rate is above ``PART``, from 1 in each part, the parts being
    ``MOST`` apart.
    """
    spark = docs.sparkSession
    own = rates(docs, TARGETS if targets is None else targets, total)
    names = [n.lower() for n in docs.columns]
    plain = [f"c{i}" for i in range(len(names))]
    of = {n: plain[names.index(n)] for n in ("doc_id", "text", "source")}
    listed = spark.createDataFrame(sorted(own.items()), "listed string, rate double")  # MAX_SOURCES rows at most
    rows = docs.toDF(*plain).join(F.broadcast(listed), F.col(of["source"]).cast("string") == F.col("listed"), "left")
    rate = F.coalesce("rate", F.lit(float(other)))
    parts = F.greatest(F.lit(1.0), F.ceil(rate / PART))
    key = identity(of["doc_id"], of["text"])
    rows = rows.select(*plain, key.alias("key"), (rate / parts).alias("rate"), parts.cast("long").alias("parts"))

    drawn = rows.filter("parts = 1").withColumn("part", F.lit(0).cast("long")).withColumn("u", uniform(F.concat(F.lit(f"{seed}|"), "key")))
    if max([other, *own.values()]) > PART:
        many = rows.filter("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        many = many.withColumn("row", F.monotonically_increasing_id()).repartition("row", "part").drop("row")
        drawn = drawn.unionByName(many.withColumn("u", uniform(F.concat_ws("|", F.lit(seed), F.lit("part"), F.col("part").cast("string"), "key"))))
    n = F.when(F.col("rate") > 0, inverted(F.col("rate"), F.col("u"))).otherwise(0)
    copies = drawn.select(*plain, "key", "part", F.explode(F.sequence(F.lit(0), n)).alias("n")).filter("n > 0")
    copies = copies.select(*plain, "key", (F.col("part") * MOST + F.col("n")).alias("copy"), F.monotonically_increasing_id().alias("row"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.col("copy").cast("string"), "key"))
    # the row's number spreads copies of rows that are equal in all else
    dealt = copies.withColumn("place", place).repartition("place", "row").sortWithinPartitions("place")
    return dealt.select(*plain, "copy").toDF(*docs.columns, fresh("copy_no", docs.columns))


def oracle(targets: dict[str, float] = TARGETS, seed: str = SEED) -> str:
    """For rates of at most ``PART``."""
    listed = ", ".join(f"('{s}', {w})" for s, w in targets.items())
    return f"""
WITH t(source, w) AS (VALUES {listed}),
n AS (SELECT source, w, count(*) AS n FROM documents JOIN t USING (source) GROUP BY ALL),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
d AS (SELECT documents.*, coalesce(rate, 1.0)::DOUBLE AS rate,
    (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 't' || coalesce(text, ''))), 1, {_DIGITS}))::BIGINT + 0.5) / {2 ** (4 * _DIGITS)}::DOUBLE AS u
    FROM documents LEFT JOIN r USING (source)),
c AS (SELECT *, CASE WHEN rate = 0 THEN 0 ELSE len(list_filter(range((rate + 12 * sqrt(rate) + 40)::INT),
    lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1)))) <= u)) END AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::BIGINT AS copy_no FROM c"""
