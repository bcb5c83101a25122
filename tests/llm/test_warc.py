import io
import random

import zstandard
from pyspark.sql.functions import spark_partition_id

from talkmill.llm import warc
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_equals_oracle(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    same(warc.read(spark, warc.write(pages, f"file://{tmp_path}/w")), warc.oracle(), SF)


def test_odd_rows_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choice("abcé<>\n ") for _ in range(3_000_000))
    rows = [
        (1, "http://a/é x\r\nEvil: 1", "same", "s"), (5, "http://b", "same", "s"), (None, None, "same", "s"), (7, None, None, "s"), (8, "u", "", None),
        (9, "u", big, "x"), (5, "http://b", "same", "s"), (None, "u", "only null", "x"), (None, "u", "only null", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    manifest = warc.write(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, manifest).collect()), key=str)
    assert got == sorted(
        [(1, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (None, 4, "revisit", 5), (7, 0, "revisit", 8), (8, 0, "response", None),
         (9, len(big.encode()), "response", None), (None, 9, "response", None), (None, 9, "response", None)], key=str)
    assert warc.read(spark, warc.write(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_archive_has_dictionary_and_single_records(tmp_path):
    path = f"file:{tmp_path}/a.warc.zst"
    rng = random.Random(4)
    pages = [("<html><body class='post'>" + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=200))).encode() for _ in range(300)]
    fs, at = warc._files(path)
    archive = warc.Archive(fs, at)
    made = [warc.record(i, f"http://h/{i}", p, len(p), warc.digest_of(p), None, False) for i, p in enumerate(pages)]
    for r in made:
        archive.add(r)
    _, n, size, dictionary_bytes = archive.close()
    data = open(at, "rb").read()
    assert n == 300 and size == len(data) and data[:4] == (0x184D2A5D).to_bytes(4, "little") and dictionary_bytes > 0
    assert list(warc.records_of(io.BytesIO(data))) == made
    plain = sum(len(zstandard.compress(r, warc.LEVEL)) for r in made)
    assert size < plain
    assert warc.parse(made[3])[1] == pages[3]


def test_many_partitions_and_one_large_group_of_equal_payloads(spark, tmp_path):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        page = "<p>" + "the same page over and over " * 400
        rows = [(i, f"http://h/{i}", page if i % 3 == 0 else f"<p>{i}") for i in range(3000)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(61)
        plan = warc.plan(pages)
        assert plan.filter("revisit and payload is not null").isEmpty()
        manifest = warc.write(pages, str(tmp_path / "w"))
        got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, manifest).collect()}
        assert got == {i: ("revisit", 2997) if i % 3 == 0 and i < 2997 else ("response", None) for i in range(3000)}
        # the copies do not meet in one task
        parts = plan.filter("revisit").select(spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 1 or len(manifest.collect()) == 1
        assert all(r.archive.startswith("file:") for r in manifest.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
