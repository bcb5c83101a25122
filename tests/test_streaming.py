import random
from datetime import datetime, timedelta

import pytest

from talkmill.streaming import fold as f


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    base, rows = datetime(2024, 1, 1), []
    for i in range(400):
        kind = rng.choice([f.CHUNK] * 6 + [f.RESET, f.METRICS, f.METRICS, f.STATUS, f.CALL, f.RESULT])
        rows.append((
            i, base + timedelta(seconds=i), kind, rng.choice(["c1", "c2", None]) if kind != f.CHUNK else rng.choice(["c1", "c2"]), rng.choice(["1", "2", "3", None]), rng.choice(["A", "B"]),
            f"{i} " if kind == f.CHUNK else None, rng.random() < 0.8, "tool", "{}", "r", f"s{i}", rng.random() < 0.1, rng.choice([None, 5]), rng.choice([None, 9]), 0.5, None,
        ))
    path = str(tmp_path_factory.mktemp("messages"))
    for a in range(0, 400, 100):  # four micro-batches, in order
        spark.createDataFrame(rows[a : a + 100], f.SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{a:04}")
    return path


def stream(spark, folder):
    return spark.readStream.schema(f.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_texts_stream_equals_batch(spark, folder):
    batch = spark.read.schema(f.SCHEMA).parquet(f"{folder}/*")
    want = {r.chat_id: r.text for r in f.texts(batch).collect()}
    out = run(spark, f.stream_texts(stream(spark, folder)), "texts", "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.seq):
        last[r.chat_id] = r.text
    assert last == want and any(want.values())


def test_metrics_stream_equals_batch(spark, folder):
    batch = spark.read.schema(f.SCHEMA).parquet(f"{folder}/*")
    out = run(spark, f.agent_metrics(stream(spark, folder)), "metrics", "complete")
    assert sorted(map(str, out.collect())) == sorted(map(str, f.agent_metrics(batch).collect()))


def test_pairs_stream_equals_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    row = lambda i, kind, key, at: (i, base + timedelta(minutes=at), kind, "c", key, "A", None, None, "t", "{}", f"r{key}", None, None, None, None, None, None)
    rows = [row(0, f.CALL, "1", 0), row(1, f.RESULT, "1", 1), row(2, f.RESULT, "2", 2), row(3, f.CALL, "2", 3), row(4, f.CALL, "3", 4), row(5, f.RESULT, "9", 5)]
    late = [row(6, f.CALL, "50", 90), row(7, f.RESULT, "50", 91), row(8, f.CALL, "60", 300), row(9, f.RESULT, "60", 300)]
    for k, part in enumerate((rows, late, [row(10, f.CALL, "70", 900), row(11, f.RESULT, "70", 900)])):
        spark.createDataFrame(part, f.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    batch = spark.read.schema(f.SCHEMA).parquet(f"{tmp_path}/*")
    want = {(r.call_id, r.result) for r in f.paired_calls(batch).collect()}
    assert want == {("1", "r1"), ("2", "r2"), ("3", None), ("50", "r50"), ("60", "r60"), ("70", "r70")}
    got = {(r.call_id, r.result) for r in run(spark, f.paired_calls(stream(spark, str(tmp_path))), "pairs", "append").collect()}
    assert got == want


def test_resent_batches_arrive_once(spark, folder, tmp_path):
    batch = spark.read.schema(f.SCHEMA).parquet(f"{folder}/*").limit(10)
    send = f.outbox(str(tmp_path / "out"))
    send(batch, 0)
    send(batch, 0)
    send(batch, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_periodic_persisting(spark, folder, tmp_path):
    q = f.persist_every(f.agent_metrics(stream(spark, folder)), str(tmp_path / "state"), str(tmp_path / "check"), seconds=0)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "state")).count() > 0


def test_statuses(spark):
    row = lambda i, agent, text, done=False: (i, None, f.STATUS, "c", None, agent, None, None, None, None, None, text, done, None, None, None, None)
    m = spark.createDataFrame([row(0, "A", " one "), row(1, "B", "two"), row(2, "A", "three"), row(3, "B", "  "), row(4, "C", "done", True)], f.SCHEMA)
    got = {r.agent: (r.text, r.completed) for r in f.statuses(m).collect()}
    assert got == {"A": ("three", True), "B": ("two", True), "C": ("done", True)}
    assert {r.agent: r.completed for r in f.statuses(m.filter("seq < 3")).collect()} == {"A": False, "B": False}


def test_debug_texts(spark):
    row = lambda i, key, text: (i, None, f.CHUNK, "c", key, "A", text, True, None, None, None, None, None, None, None, None, None)
    m = spark.createDataFrame([row(0, "1", "a"), row(1, None, "x"), row(2, "1", "b"), row(3, None, "y"), row(4, "2", "")], f.SCHEMA)
    assert [(r.seq, r.id, r.text) for r in f.debug_texts(m).orderBy("seq").collect()] == [(0, "1", "ab"), (1, None, "x"), (3, None, "y")]
    assert [(r.seq, r.text) for r in f.replaced_texts(m).orderBy("seq").collect()] == [(0, "b"), (1, "x"), (3, "y")]
    assert f.for_chat(m.unionByName(m.limit(1).selectExpr("seq", "event_ts", "type", "'d' AS chat_id", *m.columns[4:])), "c").count() == 5
