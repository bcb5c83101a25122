"""Queries over session state: ``events`` as visits and writes, ``conversations`` as chats, ``labels`` as file choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.operators import sessions as ops
from talkmill.sources.tables import load

from .base import query

#: 2024-02-20 00:00 UTC.
NOW = 1708387200




_UNTIL = "v AS (SELECT user_id AS session_id, max(epoch_us(ts)) / 1e6 + 2592000 AS valid_until FROM events GROUP BY ALL)"


def _sessions(spark, sf):
    t = load(spark, sf, "events").withColumn("at", F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))))
    return ops.seen_until(t, "user_id", "at").withColumnRenamed("user_id", "session_id")


@query("t12_session_expiry", f"WITH {_UNTIL} SELECT * FROM v")
def expiry(spark, sf):
    return _sessions(spark, sf)


@query("f2_valid_sessions", f"WITH {_UNTIL} SELECT session_id, valid_until > {NOW + 10 * 86400 - 3600} AS valid FROM v")
def valid(spark, sf):
    return _sessions(spark, sf).select("session_id", ops.is_valid(F.col("valid_until"), F.lit(NOW + 10 * 86400 - 3600)).alias("valid"))


@query("s3_kept_sessions", f"WITH {_UNTIL} SELECT session_id FROM v WHERE valid_until > {NOW + 10 * 86400 - 3600}")
def kept(spark, sf):
    return ops.split_expired(_sessions(spark, sf), NOW + 10 * 86400 - 3600)[0].select("session_id")


@query("k2_purged_sessions", f"WITH {_UNTIL} SELECT session_id FROM v WHERE NOT valid_until > {NOW + 10 * 86400 - 3600}")
def purged(spark, sf):
    return ops.split_expired(_sessions(spark, sf), NOW + 10 * 86400 - 3600)[1].select("session_id")


@query("s1_session_by_key", "SELECT event_id, event_type FROM events WHERE event_id = 42")
def by_key(spark, sf):
    return ops.by_key(load(spark, sf, "events"), "event_id", 42).select("event_id", "event_type")


@query("s2_session_keys", "SELECT event_id FROM events")
def keys(spark, sf):
    return load(spark, sf, "events").select("event_id")


@query("k1_upserted", """WITH new AS (SELECT user_id, event_type, value FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
old AS (SELECT user_id, event_type, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def upserted(spark, sf):
    e = load(spark, sf, "events")
    first = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min(F.struct("event_id", "event_type", "value")).alias("r")).select("user_id", "r.event_id", "r.event_type", "r.value")
    new = e.filter("event_id % 2 = 1").select("user_id", "event_id", "event_type", "value")
    return ops.upserted(first, new, "user_id", "event_id").select("user_id", "event_type", "value")


@query("k2_deleted", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deleted(spark, sf):
    gone = load(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return ops.deleted(load(spark, sf, "events"), gone, "user_id").select("event_id")


@query("p2_session_summary", """SELECT s.n_nationkey AS session_id, strftime(to_timestamp(1700000000 + s.n_nationkey * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS valid_until,
c.chats, f.files, t.tasks FROM nation AS s
LEFT JOIN (SELECT c_nationkey AS k, string_agg(c_name, ',' ORDER BY c_custkey) AS chats FROM customer GROUP BY ALL) AS c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_suppkey) AS files FROM supplier GROUP BY ALL) AS f ON f.k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, string_agg(c_mktsegment || '/' || c_custkey % 7 || '/-1', ',' ORDER BY c_custkey) AS tasks FROM customer GROUP BY ALL) AS t ON t.k = n_nationkey""")
def summary(spark, sf):
    n, c, s = (load(spark, sf, t) for t in ("nation", "customer", "supplier"))
    out = ops.summaries(
        n.select(F.col("n_nationkey").alias("session_id"), (F.lit(1700000000) + F.col("n_nationkey") * 3600).alias("valid_until")),
        c.select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name")),
        s.select(F.col("s_nationkey").alias("session_id"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name")),
        c.select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("query"), (F.col("c_custkey") % 7).alias("interval"), F.lit(-1).alias("repetitions")),
    )
    task = lambda x: F.concat_ws("/", x["query"], x["interval"].cast("string"), x["repetitions"].cast("string"))
    return out.select("session_id", "valid_until", F.array_join("chats", ",").alias("chats"), F.array_join("files", ",").alias("files"), F.array_join(F.transform("tasks", task), ",").alias("tasks"))


@query("a5_top_id", "SELECT user_id, greatest(user_id * 100, max(event_id)) AS top FROM events GROUP BY user_id")
def top_id(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(ops.top_id(F.max(F.col("user_id") * 100), F.col("event_id")).alias("top"))


@query("w4_task_ids", """SELECT event_id, user_id AS session_id, coalesce(last_id, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS task_id
FROM events LEFT JOIN (SELECT c_custkey, c_custkey * 10 AS last_id FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id""")
def task_ids(spark, sf):
    last = load(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") * 10).alias("last_id"))
    t = load(spark, sf, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"))
    return ops.numbered_tasks(t, last).select("event_id", "session_id", "task_id")


_SETS = "e AS (SELECT user_id, event_id % 7 AS part, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY ALL)"


def _sets(spark, sf):
    return load(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 7).alias("part")).agg(F.array_sort(F.collect_set("event_type")).alias("s"))


@query("u1_toggled_files", f"WITH {_SETS} SELECT user_id, part, array_to_string(list_sort(list_distinct(list_concat(list_filter(s, lambda x: x <> 'click' AND x <> 'view'), ['view', 'new']))), ',') AS active FROM e")
def toggled(spark, sf):
    lit = lambda *x: F.array(*map(F.lit, x))
    out = ops.toggled(F.col("s"), lit("click", "view"), lit("view", "new"))
    return _sets(spark, sf).select("user_id", "part", F.array_join(F.array_sort(out), ",").alias("active"))


@query("u2_added_files", f"WITH {_SETS} SELECT user_id, part, array_to_string(list_sort(list_distinct(list_concat(s, ['new', 'new', 'view']))), ',') AS active FROM e")
def added(spark, sf):
    out = F.array_union("s", F.array(F.lit("new"), F.lit("new"), F.lit("view")))
    return _sets(spark, sf).select("user_id", "part", F.array_join(F.array_sort(out), ",").alias("active"))


@query("u6_removed_file", f"WITH {_SETS} SELECT user_id, part, array_to_string(list_filter(s, lambda x: x <> 'click'), ',') AS active FROM e")
def removed(spark, sf):
    return _sets(spark, sf).select("user_id", "part", F.array_join(F.array_remove("s", "click"), ",").alias("active"))


@query("u7_subscribed", "SELECT event_id % 400 AS task_id, user_id AS chat_id FROM events UNION SELECT 7, 7")
def subscribed(spark, sf):
    e = load(spark, sf, "events").select((F.col("event_id") % 400).alias("task_id"), F.col("user_id").alias("chat_id"))
    return e.unionByName(spark.range(1).select(F.lit(7).cast("bigint").alias("task_id"), F.lit(7).cast("bigint").alias("chat_id"))).distinct()


@query("m1_get_or_create", "SELECT c_custkey AS chat_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT user_id, NULL FROM events WHERE user_id % 2 = 1 OR user_id NOT IN (SELECT c_custkey FROM customer)")
def get_or_create(spark, sf):
    chats = load(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.lit(1).alias("session_id"), F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("name"))
    wanted = load(spark, sf, "events").select(F.lit(1).alias("session_id"), F.col("user_id").alias("chat_id"))
    return ops.get_or_create(chats, wanted).select("chat_id", "name")


@query("m2_upserted_at_place", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE n_name END AS name, n_nationkey AS pos FROM nation
UNION ALL SELECT * FROM (VALUES (100, 'new', 25), (105, 'new', 26))""")
def at_place(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    new = n.filter("id % 5 = 0").select("id", F.lit("new").alias("name")).unionByName(spark.createDataFrame([(105, "new"), (100, "new")], "id int, name string"))
    return ops.upsert_at_place(n, new)


@query("m3_set_approvals", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'deny' ELSE 'ask' END AS one, 'allow' AS two, CASE WHEN p_size % 3 = 0 THEN 'ask' END AS three FROM part")
def approvals(spark, sf):
    p = load(spark, sf, "part")
    old = F.create_map(F.lit("c1"), F.create_map(F.lit("one"), F.lit("ask"), F.lit("two"), F.lit("allow")))
    new = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("c1"), F.create_map(F.lit("one"), F.lit("deny")))).otherwise(F.create_map().cast("map<string,map<string,string>>"))
    other = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("c2"), F.create_map(F.lit("three"), F.lit("ask")))).otherwise(F.create_map().cast("map<string,map<string,string>>"))
    out = ops.with_approvals(ops.with_approvals(old, new), other)
    get = lambda c, t: F.try_element_at(F.try_element_at(out, F.lit(c)), F.lit(t))
    return p.select("p_partkey", get("c1", "one").alias("one"), get("c1", "two").alias("two"), get("c2", "three").alias("three"))


_ADMIN = ["LOGOUT", "STOP_TASKS", "BLOCK", "UNBLOCK"]


@query("m4_administered", """WITH a AS (SELECT event_id AS seq, user_id AS session_id, CASE WHEN event_id % 97 = 0 THEN 'DELETE' ELSE ['LOGOUT', 'STOP_TASKS', 'BLOCK', 'UNBLOCK'][event_id % 50 + 1] END AS action FROM events),
g AS (SELECT session_id, bool_or(action = 'DELETE') AS d, bool_or(action = 'LOGOUT') AS l, bool_or(action = 'STOP_TASKS') AS t, arg_max(action = 'BLOCK', seq) FILTER (action IN ('BLOCK', 'UNBLOCK')) AS b FROM a WHERE action IS NOT NULL GROUP BY ALL)
SELECT c_custkey AS session_id, CASE WHEN NOT coalesce(l, false) THEN c_name END AS user_id, CASE WHEN coalesce(t, false) THEN 0 ELSE c_custkey % 9 END AS n_tasks, coalesce(b, c_custkey % 10 = 0) AS blocked
FROM customer LEFT JOIN g ON session_id = c_custkey WHERE NOT coalesce(d, false)""")
def administered(spark, sf):
    c = load(spark, sf, "customer")
    sessions = c.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("user_id"), (F.col("c_custkey") % 9).alias("n_tasks"), (F.col("c_custkey") % 10 == 0).alias("blocked"))
    e = load(spark, sf, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "DELETE").otherwise(F.get(F.array(*map(F.lit, _ADMIN)), (F.col("event_id") % 50).cast("int")))
    actions = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("action")).filter("action IS NOT NULL")
    return ops.administered(sessions, actions)


@query("f18_unblocked", "SELECT c_custkey FROM customer WHERE NOT c_custkey % 10 = 0")
def unblocked(spark, sf):
    return load(spark, sf, "customer").withColumn("blocked", F.col("c_custkey") % 10 == 0).filter(~F.col("blocked")).select("c_custkey")


@query("m6_renamed_chats", "SELECT n_nationkey AS chat_id, CASE WHEN n_nationkey < 5 THEN 'R ' || n_name ELSE n_name END AS name FROM nation")
def renamed(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("chat_id"), F.col("n_name").alias("name"))
    new = n.filter("chat_id < 5").select("chat_id", F.concat(F.lit("R "), "name").alias("name"))
    return ops.upserted(n, new, "chat_id")


@query("j14_user_sessions", f"""WITH own AS (SELECT c_name AS user_id, min(c_custkey) AS own_id FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL)
SELECT c_name AS user_id, coalesce('s' || own_id, 's' || c_custkey || ':' || c_name) AS user_session_id, own_id IS NULL AS created, CASE WHEN own_id IS NULL THEN 's' || c_custkey END AS original_session_id,
CASE WHEN own_id IS NULL THEN {ops.FAR} END AS valid_until FROM customer LEFT JOIN own ON user_id = c_name""")
def user_sessions(spark, sf):
    c = load(spark, sf, "customer")
    sid = F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    sessions = c.select(sid.alias("session_id"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("user_id"), F.lit(1).alias("valid_until"), F.lit(False).alias("blocked"))
    return ops.user_sessions(c.select(F.col("c_name").alias("user_id"), sid.alias("session_id")), sessions)


@query("k8_appended_pushes", """WITH r AS (SELECT conv_id AS chat_id, turn AS response_idx, text AS content, NULL::BIGINT AS task_id FROM conversations), l AS (SELECT chat_id, max(response_idx) AS last FROM r GROUP BY ALL)
SELECT * FROM r UNION ALL SELECT user_id, coalesce(last, -1) + row_number() OVER (PARTITION BY user_id ORDER BY event_id), event_type, event_id FROM events LEFT JOIN l ON chat_id = user_id WHERE event_type = 'error'""")
def appended(spark, sf):
    r = load(spark, sf, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("response_idx"), F.lit("").alias("query"), F.col("text").alias("content"))
    p = load(spark, sf, "events").filter("event_type = 'error'")
    p = p.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("task_id"), F.lit("").alias("query"), F.col("event_type").alias("content"))
    return ops.appended(r, p).select("chat_id", "response_idx", "content", "task_id")


@query("m8_cancelled_task", "SELECT event_id AS task_id FROM events WHERE event_id NOT IN (SELECT item_id * 3 FROM benchmark)")
def cancelled(spark, sf):
    gone = load(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("task_id"))
    return ops.deleted(load(spark, sf, "events").select(F.col("event_id").alias("task_id")), gone, "task_id")
