import math

import pytest
from pyspark.sql.functions import spark_partition_id

from talkmill.llm import mixing as m
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_equals_oracle(spark):
    same(m.mix(spark.read.parquet(f"{SF}/documents.parquet")), m.oracle(), SF)


def test_shares_meet_targets_and_draws_repeat(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 9}", i) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int").repartition(7)
    out = m.mix(docs, {"hot": 1, "s0": 2, "s3": 1, "s6": 0})
    assert out.columns == [*docs.columns, "copy_no_"]
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(got.values())
    assert "s6" not in got and abs(total - 6000) < 5 * math.sqrt(6000 * 4)
    for s, share in (("hot", 0.25), ("s0", 0.5), ("s3", 0.25)):
        assert abs(got[s] / total - share) < 0.03
    again = m.mix(docs.repartition(2), {"hot": 1, "s0": 2, "s3": 1, "s6": 0})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (None, "a", "src1", 1), (1, "b", "unlisted", 1), (1, "b", "unlisted", 1), (2, "", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _extra int")
    out = m.mix(docs, total=20.0)
    assert out.columns == [*docs.columns, "copy_no"]
    twice = [r.copy_no for r in out.collect() if r.doc_id == 1]
    assert all(twice.count(c) == 2 for c in twice)
    assert m.mix(docs.limit(0)).count() == 0 and m.mix(docs, {}).count() >= 0


def test_inversion_is_poisson(spark):
    from pyspark.sql import functions as F

    def least(rate, u):
        k, p = 0, math.exp(-rate)
        s = p
        while s <= u:
            k += 1
            p *= rate / k
            s += p
        return k

    us = [1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    rows = [(r, u, least(r, u)) for r in (0.001, 0.15, 1.0, 7.3, 32.0) for u in us]
    got = spark.createDataFrame(rows, "rate double, u double, k int").withColumn("n", m.inverted(F.col("rate"), F.col("u"))).collect()
    assert [(r.rate, r.u, r.n) for r in got] == [(r.rate, r.u, r.k) for r in got]


@pytest.fixture
def dealt(spark):
    """Partitions stay as they are dealt, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_rare_source_of_a_large_weight(spark, dealt):
    import time

    rows = [(i, f"t{i}", "hot", 0) for i in range(20_000)] + [(10**6, "one rare row", "rare", 0), (None, None, "rare", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, COPY_NO int").repartition(4)
    began = time.perf_counter()
    out = m.mix(docs, {"hot": 1, "rare": 1})
    got = {(r.source, r.doc_id): r["count"] for r in out.groupBy("source", "doc_id").count().filter("source = 'rare'").collect()}
    assert time.perf_counter() - began < 20
    for n in got.values():  # each of a rate of 5000.5
        assert abs(n - 5000) < 5 * math.sqrt(5000)
    rare = out.filter("doc_id = 1000000")
    assert rare.select("copy_no_").distinct().count() == rare.count()
    sizes = [r["count"] for r in rare.groupBy(spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_equal_rows_are_spread(spark, dealt):
    docs = spark.createDataFrame([(None, "the same text", "src0")] * 4000, "doc_id long, text string, source string")
    sizes = [r["count"] for r in m.mix(docs, {}, other=4.0).groupBy(spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
