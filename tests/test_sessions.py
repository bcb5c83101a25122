import json

from pyspark.sql import functions as F

from talkmill.operators import sessions as s


def test_corrupt_documents_are_kept_apart(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join([json.dumps({"_id": "a", "n": 1}), "{broken", json.dumps({"_id": "b", "n": "text"})]))
    good, bad = s.read_documents(spark, str(tmp_path / "d.json"), "_id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 2
    assert s.by_key(good, "_id", "a").count() == 1 and s.by_key(good, "_id", "z").count() == 0


def test_upsert_and_expiry(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {tuple(r) for r in s.upserted(old, new, "k", "seq").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    keep, purge = s.split_expired(spark.createDataFrame([("x", 5.0), ("y", 10.0), ("z", None)], "id string, valid_until double"), 5.0)
    assert [r.id for r in keep.collect()] == ["y"] and {r.id for r in purge.collect()} == {"x", "z"}


def test_places_and_sets(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "id string, v string, pos int")
    new = spark.createDataFrame([("a", "x"), ("c", "y")], "id string, v string")
    assert sorted((r.pos, r.id, r.v) for r in s.upsert_at_place(old, new).collect()) == [(0, "a", "x"), (1, "b", "2"), (2, "c", "y")]
    lit = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(s.toggled(lit("a", "b"), lit("a", "c"), lit("c", "b"))).first()[0] == ["b", "c"]
    out = s.with_approvals(F.lit(None).cast("map<string,map<string,string>>"), F.create_map(F.lit("c"), F.create_map(F.lit("t"), F.lit("ask"))))
    assert spark.range(1).select(out).first()[0] == {"c": {"t": "ask"}}


def test_admin_actions_in_order(spark):
    t = spark.createDataFrame([("a", "u", 2, False), ("b", "v", 3, True), ("c", "w", 1, False)], "session_id string, user_id string, n_tasks long, blocked boolean")
    a = spark.createDataFrame([("a", 1, "BLOCK"), ("a", 2, "UNBLOCK"), ("a", 3, "LOGOUT"), ("b", 1, "STOP_TASKS"), ("c", 1, "DELETE")], "session_id string, seq int, action string")
    assert {tuple(r) for r in s.administered(t, a).collect()} == {("a", None, 2, False), ("b", "v", 0, True)}


def test_user_sessions(spark):
    t = spark.createDataFrame([("s1", 0, None, 1, False), ("s2", 1, "ann", 1, False), ("s3", 2, "ann", 1, False)], "session_id string, pos int, user_id string, valid_until long, blocked boolean")
    l = spark.createDataFrame([("ann", "s1"), ("bob", "s1")], "user_id string, session_id string")
    got = {r.user_id: tuple(r)[1:] for r in s.user_sessions(l, t).collect()}
    assert got == {"ann": ("s2", False, None, None), "bob": ("s1:bob", True, "s1", s.FAR)}
