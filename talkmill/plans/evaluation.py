"""Queries over runs: ``labels`` and ``documents`` as scored answers, ``events`` as metric messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.operators import evaluation as ops
from talkmill.sources.tables import load, metrics

from .base import query

#: Line numbers repeat within an order, so lines stand by number, part and supplier.
_POS = "((l_linenumber * 100000000L + l_partkey) * 100000000L + l_suppkey)"

_METRICS = """m AS (SELECT event_type AS agent, user_id AS chat_id, event_id AS seq, value AS execution_time, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS input_tokens,
json_extract_string(props, '$.k')::BIGINT * 2 + event_id % 5 AS total_tokens FROM events)"""
_AGENT = "count(*) AS count, sum(coalesce(input_tokens, 0))::BIGINT AS tokens_in, sum(coalesce(total_tokens, 0) - coalesce(input_tokens, 0))::BIGINT AS tokens_out, round(sum(execution_time), 4) AS execution_time"


@query("a1_agent_metrics", f"WITH {_METRICS} SELECT agent, {_AGENT} FROM m GROUP BY ALL")
def agent_metrics(spark, sf):
    return ops.agent_metrics(metrics(spark, sf)).withColumn("execution_time", F.round("execution_time", 4))


@query("a1_chat_agent_metrics", f"WITH {_METRICS} SELECT agent, chat_id, {_AGENT} FROM m GROUP BY ALL")
def chat_agent_metrics(spark, sf):
    return ops.agent_metrics(metrics(spark, sf), "chat_id").withColumn("execution_time", F.round("execution_time", 4))


@query("a2_question_agent_time", "SELECT user_id AS question_id, event_type AS agent, round(sum(value), 4) AS time FROM events GROUP BY ALL")
def question_agent_time(spark, sf):
    t = load(spark, sf, "events")
    return t.groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("agent")).agg(F.round(F.sum("value"), 4).alias("time"))


@query("a3_question_tokens", """SELECT user_id AS question_id, sum(CASE WHEN event_id % 2 = 0 THEN k ELSE 0 END)::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens, sum(k)::BIGINT AS total_tokens,
sum(event_id % 3)::BIGINT AS calls, count(*) FILTER (event_id % 3 > 0) AS iterations_with_calls FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY ALL""")
def question_tokens(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    even = F.col("event_id") % 2 == 0
    meta = F.when(even, F.create_map(F.lit("prompt_tokens"), k, F.lit("total_tokens"), k)).otherwise(F.create_map(F.lit("total_tokens"), k))
    tools = F.when(F.col("event_id") % 3 > 0, F.array_repeat("event_type", (F.col("event_id") % 3).cast("int")))
    return ops.question_tokens(load(spark, sf, "events").select(F.col("user_id").alias("question_id"), meta.alias("meta"), tools.alias("tools")))


def _results(spark, sf):
    """All scored answers, of the runs 0 and 1."""
    d, l = load(spark, sf, "documents"), load(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        (F.col("doc_id") % 2).alias("run"), F.col("source").alias("method"), F.col("lang").alias("model"), (1 - F.col("quality")).alias("missed"), F.col("toxic").alias("extra"),
        F.col("n_chars").alias("tokens"), (F.col("n_chars") / 8).alias("time"), (F.col("n_chars") / 16).alias("server_time"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5 + 1).alias("score"),
    )


_RUNS = """SELECT {} source AS method, lang AS model, count(*) AS questions, count(*) FILTER (quality = 1) AS correct, count(*) FILTER (quality = 1 AND toxic = 0) AS perfect,
sum(n_chars)::BIGINT AS tokens, sum(n_chars / 8) AS time, sum(n_chars / 16) AS server_time, sum(CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 + 1 ELSE 0 END) / count(*) AS average_score
FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""
_RUN = "SELECT * FROM (" + _RUNS.format("doc_id % 2 AS run,") + ") WHERE run = {}"


def _summary(spark, sf, run):
    return ops.summary(_results(spark, sf), "run").filter(F.col("run") == run).drop("run")


@query("a4_run_summary", f"SELECT * REPLACE (round(average_score, 6) AS average_score) FROM ({_RUNS.format('')})")
def run_summary(spark, sf):
    return ops.summary(_results(spark, sf)).withColumn("average_score", F.round("average_score", 6))


@query("a4b_score_over_question_set", f"SELECT method, model, 500::BIGINT AS questions, round(average_score, 6) AS average_score FROM ({_RUNS.format('')})")
def score_over_set(spark, sf):
    return ops.summary(_results(spark, sf), questions=500).select("method", "model", "questions", F.round("average_score", 6).alias("average_score"))


_ALL_TIMES = "SELECT {} source AS method, lang AS model, 'agent' || n_chars % 4 AS agent, sum((n_chars - 2000) / 8) AS time FROM documents GROUP BY ALL HAVING sum((n_chars - 2000) / 8) > 0"
_TIMES = "SELECT * FROM (" + _ALL_TIMES.format("doc_id % 2 AS run,") + ") WHERE run = {}"


def _times(spark, sf, *keys):
    d = load(spark, sf, "documents").withColumn("run", F.col("doc_id") % 2)
    return ops.agent_time(d.select("run", F.col("source").alias("method"), F.col("lang").alias("model"), F.concat(F.lit("agent"), (F.col("n_chars") % 4).cast("string")).alias("agent"), ((F.col("n_chars") - 2000) / 8).alias("time")), *keys)


@query("a4a_agent_time", _ALL_TIMES.format(""))
def agent_time(spark, sf):
    return _times(spark, sf)


@query("j10_agent_differences", f"SELECT n.method, n.model, n.agent, printf('%.2fs', n.time - o.time) AS time_difference FROM ({_TIMES.format(1)}) AS n JOIN ({_TIMES.format(0)}) AS o USING (method, model, agent)")
def agent_differences(spark, sf):
    both = _times(spark, sf, "run")
    return ops.agent_differences(both.filter("run = 1").drop("run"), both.filter("run = 0").drop("run"))


@query("a11_run_comparison", f"""SELECT n.method, n.model, printf('%.2f%%', (n.correct / n.questions - o.correct / o.questions) * 100) AS correct_difference,
printf('%.2f%%', (n.perfect / n.questions - o.perfect / o.questions) * 100) AS perfect_difference, printf('%.2fs', n.time - o.time) AS time_difference, (n.tokens - o.tokens) || ' tokens' AS token_difference,
CASE WHEN o.average_score <> 0 THEN round(n.average_score / o.average_score * 100, 6) END AS score_percent FROM ({_RUN.format(1)}) AS n JOIN ({_RUN.format(0)}) AS o USING (method, model)""")
def comparison(spark, sf):
    return ops.compared(_summary(spark, sf, 1), _summary(spark, sf, 0))


@query("j9_only_in_new", f"SELECT method, model FROM ({_RUN.format(1)}) AS n WHERE NOT EXISTS (FROM ({_RUN.format(0)}) AS o WHERE o.method = n.method AND o.model = n.model AND o.method <> 'src3')")
def only_new(spark, sf):
    return ops.only_new(_summary(spark, sf, 1), _summary(spark, sf, 0).filter("method <> 'src3'"))


@query("w1_chunks", "SELECT item_id, ntile(7) OVER (ORDER BY item_id) - 1 AS chunk FROM benchmark")
def chunks(spark, sf):
    b = load(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("pos"), F.lit("all").alias("set"))
    return ops.chunked(b, 7, "set").select("item_id", F.col("chunk").cast("bigint").alias("chunk"))


@query("l3_portion", "SELECT * FROM benchmark ORDER BY md5('4|' || item_id) LIMIT (SELECT (count(*) * 30 // 100)::BIGINT FROM benchmark)")
def portion(spark, sf):
    return ops.portion(load(spark, sf, "benchmark"), 30, seed=4, key="item_id")


@query("l5_expected_order", f"SELECT l_orderkey AS question_id, {_POS} AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 7, {_POS}) AS rank FROM lineitem".replace("100000000L", "100000000"))
def expected_order(spark, sf):
    """Expected calls of each question by id, ties in order."""
    w = Window.partitionBy("question_id").orderBy("id", "pos")
    calls = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.expr(_POS).alias("pos"), (F.col("l_suppkey") % 7).alias("id"))
    return calls.select("question_id", "pos", F.row_number().over(w).cast("bigint").alias("rank"))


@query("u4_question_union", "SELECT item_id, 'simple' AS set FROM benchmark UNION ALL SELECT item_id, 'complex' FROM benchmark WHERE length(text) > 120")
def question_union(spark, sf):
    """All questions one set after the other; long ones are of both."""
    b = load(spark, sf, "benchmark")
    return b.select("item_id", F.lit("simple").alias("set")).unionAll(b.filter(F.length("text") > 120).select("item_id", F.lit("complex").alias("set")))


@query("u5_multiset_difference", "SELECT source, lang FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 2 = 1")
def multiset_difference(spark, sf):
    d = load(spark, sf, "documents")
    return d.filter("doc_id % 2 = 0").select("source", "lang").exceptAll(d.filter("doc_id % 2 = 1").select("source", "lang"))


@query("u8_flattened", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_type, event_id) AS ids FROM events GROUP BY ALL")
def flattened(spark, sf):
    per = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    nested = per.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "ids"))).alias("lists"))
    ids = F.flatten(F.transform("lists", lambda x: x["ids"]))
    return nested.select("user_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("p11_calls_by_iteration", "SELECT l_orderkey AS question_id, count(DISTINCT l_linestatus)::INT AS iterations, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_linestatus = 'O') AS open_calls FROM lineitem GROUP BY ALL")
def by_iteration(spark, sf):
    t = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linestatus").alias("iteration"), F.expr(_POS).alias("pos"), F.col("l_partkey").cast("string").alias("name"), F.lit("{}").alias("args"))
    out = ops.calls_by_iteration(t)
    calls = F.try_element_at("iterations", F.lit("O"))
    return out.select("question_id", F.size("iterations").alias("iterations"), F.array_join(F.transform(calls, lambda c: c["name"]), ",").alias("open_calls"))


def _calls(spark, sf):
    t = load(spark, sf, "lineitem")
    said = F.when(F.col("l_quantity") > 45, "Failed: 1").when(F.col("l_quantity") > 40, "HTTP 502").when(F.col("l_quantity") > 5, "fine")
    names = F.when(F.col("l_tax") > 0.07, F.array(F.lit("<"), F.lit(">"))).otherwise(F.array(F.lit("a")))
    return t.select(F.col("l_orderkey").alias("result_id"), F.expr(_POS).alias("pos"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), said.alias("result"), names.alias("arg_names"))


@query("f10_first_failure", """SELECT l_orderkey AS result_id, CASE WHEN max(l_quantity) > 40 THEN 'Found failed tool call: p' || arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_quantity > 40)
WHEN count(*) > 1 AND max(l_tax) > 0.07 THEN 'Found unresolved placeholder' END AS problem FROM lineitem GROUP BY ALL""")
def first_failure(spark, sf):
    return ops.first_failure(_calls(spark, sf))


@query("f11_success_lines", "SELECT l_orderkey AS result_id, coalesce(string_agg('- Worker Agent Executed: p' || l_partkey || '.', chr(10) ORDER BY l_linenumber, l_partkey) FILTER (l_quantity <= 45), '') AS output FROM lineitem GROUP BY ALL")
def success(spark, sf):
    return ops.success_lines(_calls(spark, sf))


@query("a6_rounds", "SELECT l_orderkey AS plan_id, (l_linenumber % 3)::INT AS round, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS tasks FROM lineitem GROUP BY ALL")
def rounds(spark, sf):
    t = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") % 3).cast("int").alias("round"), F.expr(_POS).alias("pos"), F.col("l_partkey").cast("string").alias("task"))
    return ops.rounds(t).withColumn("tasks", F.array_join("tasks", ","))


def _expected(spark, sf):
    t = load(spark, sf, "lineitem").filter("l_linenumber <= 4")
    arg = lambda k, v, m, o=False: F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(m).alias("match"), F.lit(o).alias("optional"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return t.select(
        F.col("l_orderkey").alias("question_id"), F.expr(_POS).alias("pos"), F.col("l_linenumber").alias("id"), F.concat(F.lit("Get"), "l_returnflag").alias("name"),
        F.array(arg("flag", text(F.lower("l_linestatus")), "partial"), arg("n", F.col("l_suppkey").cast("string"), "none", True)).alias("args"),
        (F.col("l_quantity") > 45).alias("optional"), F.when(F.col("l_linenumber") > 2, F.array(F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>")).cast("array<int>").alias("depends"),
        F.when(F.col("l_tax") > 0.06, F.array(F.array(F.lit(1)))).alias("alternatives"),
    )


_GIVEN = "CASE WHEN l_discount > 0.03 THEN l_suppkey END"


def _actual(spark, sf):
    t = load(spark, sf, "lineitem").filter("l_linenumber <> 2")
    args = F.to_json(F.struct(F.col("l_linestatus").alias("flag"), F.expr(_GIVEN).alias("n")))
    return t.select(F.col("l_orderkey").alias("question_id"), (F.col("l_linenumber") % 2).cast("int").alias("iteration"), F.expr(_POS).alias("pos"), F.concat(F.lit("agent--Get"), "l_returnflag", F.lit("s")).alias("name"), args.alias("args"))


# one step a call, as far as the longest question: the state is what is taken, which ids are matched and the pairs
@query("j7_matched_calls", f"""WITH RECURSIVE e AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_POS}) AS k, l_linenumber AS id, l_returnflag AS flag, l_linestatus AS status,
    l_quantity > 45 AS optional, l_linenumber > 2 AS depends, l_tax > 0.06 AS alternative FROM lineitem WHERE l_linenumber <= 4),
a AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, {_POS}) - 1 AS j, l_returnflag AS flag, l_linestatus AS status FROM lineitem WHERE l_linenumber <> 2),
l AS (SELECT q, list(struct_pack(j := j, flag := flag, status := status) ORDER BY j) AS calls FROM a GROUP BY q),
s AS (SELECT DISTINCT q, 0::BIGINT AS k, []::BIGINT[] AS taken, []::BIGINT[] AS ids, []::BIGINT[] AS done FROM e UNION ALL
    SELECT s.q, e.k, CASE WHEN hit THEN list_append(taken, x.j) ELSE taken END, CASE WHEN hit THEN list_append(ids, e.id::BIGINT) ELSE ids END, CASE WHEN hit THEN list_append(done, e.k) ELSE done END
    FROM s JOIN e ON e.q = s.q AND e.k = s.k + 1 LEFT JOIN l ON l.q = s.q,
    LATERAL (SELECT list_filter(coalesce(calls, []), lambda c: c.flag = e.flag AND c.status = e.status AND NOT list_contains(taken, c.j))[1].j AS j) AS x,
    LATERAL (SELECT x.j IS NOT NULL AND (NOT e.depends OR list_contains(ids, e.id - 1)) AS hit) AS y),
f AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY q))
SELECT m.q AS question_id, 'match' AS kind, (m.dk - 1)::INT AS expected_pos, m.dj::INT AS actual_pos, 'agent--Get' || a.flag || 's' AS name
FROM (SELECT q, unnest(done) AS dk, unnest(taken) AS dj FROM f) AS m JOIN a ON a.q = m.q AND a.j = m.dj
UNION ALL SELECT q, 'missed', (e.k - 1)::INT, NULL, 'Get' || flag FROM e JOIN f USING (q) WHERE NOT list_contains(done, e.k) AND NOT optional AND NOT (alternative AND list_contains(ids, 1))
UNION ALL SELECT a.q, 'extra', NULL, j::INT, 'agent--Get' || flag || 's' FROM a LEFT JOIN f USING (q) WHERE NOT list_contains(coalesce(taken, []), j)""".replace("100000000L", "100000000"))
def matched_calls(spark, sf):
    return ops.matched(_expected(spark, sf), _actual(spark, sf))


@query("j8_parameter_match", f"""SELECT event_id AS call_id, CASE event_id % 5 WHEN 0 THEN event_type <> 'view' OR event_id % 2 = 0 WHEN 1 THEN contains(event_type, 'i') WHEN 2 THEN false WHEN 3 THEN event_id % 3 = 0 ELSE true END AS fits FROM events""")
def parameter_match(spark, sf):
    """By call: an exact or a missing optional text, a partial one, a number of another type, a missing or an extra key, any text."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    arg = lambda key, v, m, o=False: F.struct(F.lit(key).alias("key"), F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.lit(1000)).alias("json"), F.lit(m).alias("match"), F.lit(o).alias("optional"))
    told = lambda key, v, m, o=False: F.array(arg(key, v, m, o))
    expected = (
        F.when(k % 5 == 0, told("x", F.when(F.col("event_type") == "view", F.lit("other")).otherwise(F.col("event_type")), "exact", True))
        .when(k % 5 == 1, told("x", F.lit("I"), "partial")).when(k % 5 == 2, told("x", k.cast("string"), "exact"))
        .when(k % 5 == 3, F.when(k % 3 == 1, told("y", F.lit("a"), "none")).when(k % 3 == 0, told("x", F.lit("a"), "none")).otherwise(told("y", F.lit("a"), "none", True)))
        .otherwise(told("x", F.lit("b"), "none"))
    )
    expected = F.transform(expected, lambda a: F.struct(a["key"].alias("key"), F.regexp_replace(a["json"], "}$", "").alias("value"), a["match"].alias("match"), a["optional"].alias("optional")))
    args = F.when(k % 5 == 2, F.to_json(F.struct(k.alias("x")))).when((k % 5 == 0) & (k % 2 == 0), F.lit("{}")).otherwise(F.to_json(F.struct(F.col("event_type").alias("x"))))
    return ops.parameter_matches(e.select(k.alias("call_id"), args.alias("args"), expected.alias("expected")))
