"""Queries over what is written to files and read back: specifications, libraries, results, questions, uploads, logs; and tools by name."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions import text as tx
from talkmill.operators import catalog, code, evaluation, files, methods, prompts
from talkmill.operators.registry import tools
from talkmill.sources import questions, results
from talkmill.sources.shared import own_folder
from talkmill.sources.tables import load

from .base import query


def _document(spark, text: str, path: str) -> str:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("s4_openapi_operations", """SELECT '/n' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'get' ELSE 'post' END AS method, 'c;' || n_regionkey || ';' || n_name AS operation_id, n_comment AS description,
CASE WHEN n_nationkey % 2 = 1 THEN '{"type":"object","properties":{"id":{"type":"integer"},"next":{"type":"string"}}}' END AS schema FROM (SELECT *, 'about ' || n_name AS n_comment FROM nation)""")
def openapi(spark, sf):
    """A specification (one document, of 25 operations at any scale) is written, read, its references inlined and its operations listed."""
    paths = {}
    for n in load(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name").collect():
        operation = {"operationId": f"c;{n.n_regionkey};{n.n_name}", "description": f"about {n.n_name}"}
        if n.n_nationkey % 2:
            operation["requestBody"] = {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}
        paths[f"/n{n.n_nationkey}"] = {"post" if n.n_nationkey % 2 else "get": operation}
    parts = {"Item": {"type": "object", "properties": {"id": {"$ref": "#/components/schemas/Id"}, "next": {"type": "string"}}}, "Id": {"type": "integer"}}
    folder = own_folder(spark, "s4")
    raw = _document(spark, json.dumps({"paths": paths, "components": {"schemas": parts}}, separators=(",", ":")), f"{folder}/raw")
    spec = catalog.inline_references(json.loads(spark.read.text(raw, wholetext=True).first()[0]))
    return catalog.read_openapi(spark, _document(spark, json.dumps(spec, separators=(",", ":")), f"{folder}/inlined")).select("path", "method", "operation_id", "description", "schema")


def _library(spark, sf):
    """A user's prompts: 25 at any scale."""
    n = load(spark, sf, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.element_at(F.array(F.lit("de"), F.lit("en")), (k % 2 + 1).cast("int")).alias("lang"), F.col("n_regionkey").cast("int").alias("cat_pos"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("id"),
        F.concat(F.lit("Header "), F.col("n_regionkey").cast("string")).alias("header"), F.lit("star").alias("icon"), (F.col("n_regionkey") > 0).alias("visible"), (F.col("n_regionkey") < 3).alias("is_default"),
        k.cast("int").alias("q_pos"), F.col("n_name").alias("question"), F.when(k % 3 == 0, F.lit("own")).alias("q_icon"),
    )


_QUESTIONS = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'en' END AS lang, 'c' || n_regionkey AS id, 'Header ' || n_regionkey AS header, n_regionkey > 0 AS visible, n_regionkey < 3 AS is_default,
row_number() OVER (PARTITION BY n_nationkey % 2, n_regionkey ORDER BY n_nationkey) - 1 AS q_pos, n_name AS question, CASE WHEN n_nationkey % 3 = 0 THEN 'own' END AS q_icon FROM nation"""
_COLUMNS = ("lang", "id", "header", "visible", "is_default", "q_pos", "question", "q_icon")


@query("s7_library_fallback", _QUESTIONS)
def library(spark, sf):
    """There is no override file, so the base file is read."""
    folder = own_folder(spark, "s7")
    prompts.nest_library(_library(spark, sf)).write.text(f"{folder}/base")
    return prompts.read_library(spark, f"{folder}/override", f"{folder}/base").select(*_COLUMNS).withColumn("q_pos", F.col("q_pos").cast("bigint"))


@query("k7_saved_library", f"SELECT * FROM ({_QUESTIONS}) WHERE is_default")
def saved_library(spark, sf):
    """Saved over another one, and read in place of the base file."""
    folder = own_folder(spark, "k7")
    rows = _library(spark, sf)
    for saved in (rows, rows.filter("is_default")):
        prompts.nest_library(saved).write.mode("overwrite").text(f"{folder}/override")
    return prompts.read_library(spark, f"{folder}/override", f"{folder}/base").select(*_COLUMNS).withColumn("q_pos", F.col("q_pos").cast("bigint"))


def _result_file(spark, sf, folder: str, shift: int) -> str:
    """A result file of 25 answers at any scale: method and model by region."""
    runs: dict = {}
    for n in load(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect():
        k = n.n_nationkey + shift
        answer = {"question": f"q{k}", "time": k / 4, "server_time": k / 8, "score": k % 5 + 1, "response_metadata": {"total_tokens": k}, "agent_time": {"a": k / 4}, "tool_matches": {"match": [], "missed": ["m"] * (k % 2), "extra": ["e"] * (k % 3)}}
        runs.setdefault(f"m{n.n_regionkey % 2}", {}).setdefault(f"r{n.n_regionkey}", {"questions": []})["questions"].append(answer)
    for models in runs.values():
        for run in models.values():
            qs = run["questions"]
            run["summary"] = {
                "questions": len(qs), "correct_tool_usage": sum(not q["tool_matches"]["missed"] for q in qs), "perfect_tool_usage": sum(not q["tool_matches"]["missed"] and not q["tool_matches"]["extra"] for q in qs),
                "total_time": sum(q["time"] for q in qs), "total_server_time": sum(q["server_time"] for q in qs), "agent_time": {"a": sum(q["time"] for q in qs)},
                "total_token_usage": sum(q["response_metadata"]["total_tokens"] for q in qs), "average_score": sum(q["score"] for q in qs) / len(qs),
            }
    return _document(spark, json.dumps(runs, indent=2), folder)


def _run_sql(shift: int) -> str:
    return f"""SELECT 'm' || n_regionkey % 2 AS method, 'r' || n_regionkey AS model, count(*) AS questions, count(*) FILTER (k % 2 = 0) AS correct, count(*) FILTER (k % 6 = 0) AS perfect, sum(k)::BIGINT AS tokens,
sum(k / 4) AS time, sum(k / 8) AS server_time, round(avg(k % 5 + 1), 6) AS average_score FROM (SELECT *, n_nationkey + {shift} AS k FROM nation) GROUP BY ALL"""


@query("s12_result_summaries", _run_sql(0))
def result_summaries(spark, sf):
    """A result file, its runs summed up again from their answers."""
    runs = results.read_results(spark, _result_file(spark, sf, f"{own_folder(spark, 's12')}/r", 0))
    return evaluation.summary(results.answers(runs)).withColumn("average_score", F.round("average_score", 6))


@query("k5_written_results", _run_sql(0))
def written_results(spark, sf):
    """Results written twice to one place: the file holds one document."""
    folder = own_folder(spark, "k5")
    runs = results.summaries(results.read_results(spark, _result_file(spark, sf, f"{folder}/r", 0)))
    for _ in range(2):
        results.write_json(runs, f"{folder}/out")
    back = spark.read.schema(runs.schema).json(f"{folder}/out")
    return back.withColumn("average_score", F.round("average_score", 6))


@query("k6_written_report", f"""SELECT n.method, n.model, printf('%.2f%%', (n.correct / n.questions - o.correct / o.questions) * 100) AS correct_difference, printf('%.2fs', n.time - o.time) AS time_difference, (n.tokens - o.tokens) || ' tokens' AS token_difference
FROM ({_run_sql(1)}) AS n JOIN ({_run_sql(0)}) AS o USING (method, model)""")
def written_report(spark, sf):
    folder = own_folder(spark, "k6")
    old, new = (results.summaries(results.read_results(spark, _result_file(spark, sf, f"{folder}/{k}", k))) for k in (0, 1))
    report = evaluation.compared(new, old).select("method", "model", "correct_difference", "time_difference", "token_difference")
    results.write_json(report, f"{folder}/report")
    return spark.read.schema(report.schema).json(f"{folder}/report")


@query("k3_kept_files", "SELECT c_nationkey AS session_id, c_mktsegment AS file_id, c_custkey FROM customer WHERE c_nationkey <> 3")
def kept_files(spark, sf):
    """Files written by session and file; one session's go with its folder."""
    folder = f"{own_folder(spark, 'k3')}/files"
    rows = load(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("session_id"), F.col("c_mktsegment").alias("file_id"), "c_custkey")
    files.write_files(rows, folder)
    files.drop_session(spark, folder, "3")
    return spark.read.schema(rows.schema).parquet(folder).select("session_id", "file_id", "c_custkey")


@query("s9_downloaded_files", """SELECT page_id, page_id % 5 > 0 AS ok, CASE WHEN page_id % 5 > 0 THEN CASE WHEN b = '' THEN 'file' ELSE regexp_replace(b, '\\.[^.]*$', '') END || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.bin' END END AS file_name,
CASE WHEN page_id % 5 = 0 THEN 'status 404' END AS error, CASE WHEN page_id % 5 > 0 THEN octet_length(encode(html)) END AS size
FROM (SELECT *, regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$', 1), '([^/;]*)(?:;[^/]*)?$', 1) AS b FROM pages)""")
def downloaded(spark, sf):
    """What the downloads of some addresses (answers given as rows) make of them."""
    p = load(spark, sf, "pages")
    answers = p.select("page_id", "url", F.when(F.col("page_id") % 5 > 0, 200).otherwise(404).alias("status"), F.when(F.col("page_id") % 2 == 0, "application/pdf").alias("content_type"), F.col("html").cast("binary").alias("body"))
    return files.downloaded(answers, "page_id").select("page_id", "ok", "file_name", "error", F.octet_length("body").cast("bigint").alias("size"))


@query("s11_expected_calls", """SELECT CASE WHEN item_id % 3 = 0 THEN 'complex' ELSE 'simple' END AS set, item_id AS question_id, p AS pos, CASE WHEN p = 0 THEN -1 ELSE p END AS id, 'Get' || p AS name, CASE WHEN p = 0 THEN 'exact' ELSE 'partial' END AS match
FROM (SELECT item_id, unnest(range(item_id % 3 + 1))::INT AS p FROM benchmark) WHERE item_id % 3 < 2""")
def question_corpus(spark, sf):
    """Question sets written as JSON lines and read by set."""
    folder = f"{own_folder(spark, 's11')}/questions"
    b = load(spark, sf, "benchmark")
    arg = lambda p: F.struct(F.lit("x").alias("key"), F.lit("1").alias("value"), F.when(p > 0, "partial").alias("match"))
    call = lambda p: F.struct(F.when(p > 0, p).alias("id"), F.concat(F.lit("Get"), p.cast("string")).alias("name"), F.array(arg(p)).alias("args"))
    calls = F.transform(F.sequence(F.lit(0), (F.col("item_id") % 3).cast("int")), call)
    set_ = F.when(F.col("item_id") % 3 == 0, "complex").when(F.col("item_id") % 3 == 1, "simple").otherwise("other")
    b.select(set_.alias("set"), F.col("item_id").alias("question_id"), F.col("text").alias("input"), calls.alias("tools")).write.json(folder)
    return questions.expected_calls(questions.read_questions(spark, folder, "simple", "complex")).select("set", "question_id", "pos", "id", "name", F.get("args", F.lit(0))["match"].alias("match"))


@query("k9_log_lines", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN chr(27) || '[93m' WHEN 1 THEN chr(27) || '[96m' ELSE chr(27) || '[38;20m' END || b || ' one' || chr(27) || '[0m' || chr(10) ||
CASE event_id % 3 WHEN 0 THEN chr(27) || '[93m' WHEN 1 THEN chr(27) || '[96m' ELSE chr(27) || '[38;20m' END || repeat(' ', length(b)::INT) || ' ' || event_type || chr(27) || '[0m' AS line
FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [INFO] ' || CASE event_id % 3 WHEN 0 THEN 'Orchestrator' WHEN 1 THEN 'WorkerAgent' ELSE 'mod fun' END || ' -' AS b FROM events)""")
def log_lines(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id") % 3
    agent = F.when(k == 0, "Orchestrator").when(k == 1, "WorkerAgent")
    return e.select("event_id", tx.log_lines(F.col("ts").cast("timestamp"), F.lit("INFO"), agent, F.lit("mod fun"), F.concat(F.lit("one\n"), "event_type")).alias("line"))


@query("v1_tool_catalogue", """SELECT * FROM (VALUES ('PlayBooks--LoadPlayBook', 'name:string'), ('PlayBooks--CreatePlayBook', 'id:string,name:string,when_to_use:string,what_to_do:string'),
('Scheduling--ScheduleIntervalTask', 'query:string,delay_seconds:integer,repetitions:integer'), ('Scheduling--ScheduleCalendarTask', 'query:string,time_of_day:string,weekdays:string'), ('Scheduling--GetScheduledTasks', ''),
('Scheduling--CancelScheduleTask', 'task_id:integer'), ('Chats--SearchChats', 'query:string'), ('Chats--GatherUserInfo', ''), ('Files--ReadFileFromUrl', 'url:string'), ('CodeExecution--ExecuteCode', 'code:string,timeout_s:integer'),
('CodeExecution--SolveWithCode', 'task:string,timeout_s:integer,max_code_retries:integer')) AS t(name, params)""")
def tool_catalogue(spark, sf):
    c = tools.catalogue(spark)
    return c.select(F.concat_ws("--", "provider", "tool").alias("name"), F.array_join(F.transform("properties", lambda p: F.concat_ws(":", p["name"], p["type"])), ",").alias("params"))


@query("v4_called_tool", "SELECT event_id AS task_id, event_type AS query FROM events WHERE event_id <> 42")
def called_tool(spark, sf):
    """A tool called by its name with checked arguments."""
    tasks = load(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("query"))
    return tools.call("Scheduling--CancelScheduleTask", {"tasks": tasks}, task_id=42)


_METHODS = """m(method, step, agent, planner) AS (VALUES ('simple', 0, 'assistant', NULL), ('simple-tools', 0, 'assistant', NULL), ('tool-llm', 0, 'generator', NULL), ('tool-llm', 1, 'evaluator', NULL), ('tool-llm', 2, 'output', NULL),
('self-orchestrated', 0, 'orchestrator', true), ('self-orchestrated', 1, 'planner', true), ('self-orchestrated', 2, 'worker', true), ('self-orchestrated', 3, 'output', true),
('self-orchestrated', 0, 'orchestrator', false), ('self-orchestrated', 1, 'worker', false), ('self-orchestrated', 2, 'output', false))"""


@query("v5_planned_requests", f"""WITH {_METHODS}, q AS (SELECT c_custkey AS session_id, ['simple', 'simple-tools', 'tool-llm', 'self-orchestrated'][c_custkey % 4 + 1] AS method, c_custkey % 3 <> 0 AS planner FROM customer)
SELECT session_id, q.method, step, agent, CASE WHEN agent = 'worker' AND session_id % 5 = 0 THEN 'host/own' ELSE 'default' END AS model, CASE WHEN session_id % 3 = 0 THEN 7 ELSE 5 END AS max_rounds
FROM q JOIN m ON m.method = q.method AND (m.planner IS NULL OR m.planner = q.planner)""")
def planned_requests(spark, sf):
    """Sessions answer by different methods, some with settings of their own."""
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    names = F.array(*(F.lit(n) for n in ("simple", "simple-tools", "tool-llm", "self-orchestrated")))
    method = F.get(names, (k % 4).cast("int"))
    setting = lambda key, value: F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))
    own = F.when(k % 3 == 0, F.array(setting("max_rounds", "7"), setting("use_agent_planner", "false"))).otherwise(F.array(setting("no such key", "x")))
    own = F.concat(own, F.when(k % 5 == 0, F.array(setting("worker_model", "host/own"))).otherwise(F.array(setting("worker_model", None))))
    settings = c.select(k.alias("session_id"), method.alias("method"), F.explode(own).alias("s")).select("session_id", "method", "s.key", "s.value")
    return methods.METHODS.requests(c.select(k.alias("session_id"), method.alias("method"), F.col("c_name").alias("query")), settings)


@query("v6_method_settings", """SELECT * FROM (VALUES ('simple', 'model', 'string', 'default'), ('simple', 'max_rounds', 'integer', '5'), ('simple', 'ask_policy', 'string', 'never'), ('simple-tools', 'model', 'string', 'default'),
('simple-tools', 'max_rounds', 'integer', '5'), ('tool-llm', 'tool_gen_model', 'string', 'default'), ('tool-llm', 'tool_eval_model', 'string', 'default'), ('tool-llm', 'output_model', 'string', 'default'), ('tool-llm', 'max_rounds', 'integer', '5'),
('self-orchestrated', 'orchestrator_model', 'string', 'default'), ('self-orchestrated', 'worker_model', 'string', 'default'), ('self-orchestrated', 'evaluator_model', 'string', 'default'), ('self-orchestrated', 'generator_model', 'string', 'default'),
('self-orchestrated', 'max_rounds', 'integer', '5'), ('self-orchestrated', 'max_iterations', 'integer', '3'), ('self-orchestrated', 'use_agent_planner', 'boolean', 'true'), ('self-orchestrated', 'use_agent_evaluator', 'boolean', 'false')) AS t(method, key, type, "default")""")
def method_settings(spark, sf):
    return methods.METHODS.properties(spark)


@query("v2_executions", """SELECT event_id AS run_id, 'a = ' || event_id || chr(10) || '_result = a + 1' AS code, CASE WHEN event_id % 5 = 0 OR event_id % 40 > 15 THEN 'timeout' WHEN event_id % 4 = 0 THEN 'error' ELSE 'success' END AS status,
CASE WHEN event_id % 5 > 0 AND event_id % 40 <= 15 AND event_id % 4 > 0 THEN 'out ' || event_id END AS stdout FROM events""")
def executions(spark, sf):
    """Programs as a sandbox is asked to run them, and what its answers come to: some are late, missing or too large."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    asked = code.requests(e.select(k.alias("run_id"), F.format_string("a = %d\na + 1", k).alias("code")))
    answers = e.filter("event_id % 5 > 0").select(
        k.alias("run_id"), F.lit("success").alias("status"), F.format_string("out %d", k).alias("stdout"), F.lit("").alias("stderr"), (k % 40).cast("double").alias("seconds"), F.when(k % 4 == 0, 2000).otherwise(10).alias("used_mb"),
    )
    return code.executed(asked, answers, "code").select("run_id", "code", "status", "stdout")


_ATTEMPTS = """a AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_id % 3 > 0 THEN 'p' || event_id END AS code, CASE event_type WHEN 'purchase' THEN 'success' ELSE 'error' END AS s FROM events),
b AS (SELECT *, CASE WHEN code IS NULL THEN 'no code' ELSE s END AS status FROM a WHERE attempt <= 3),
l AS (SELECT task_id, coalesce(min(attempt) FILTER (status = 'success'), max(attempt)) AS last FROM b GROUP BY ALL)"""


@query("v3_solved_tasks", f"""WITH {_ATTEMPTS} SELECT b.task_id, b.attempt, b.code, b.status, (SELECT count(*) FROM b AS p WHERE p.task_id = b.task_id AND p.attempt < last) AS failed FROM b JOIN l ON l.task_id = b.task_id AND b.attempt = last""")
def solved_tasks(spark, sf):
    """Generate, run, retry: what the attempts at each task came to."""
    e = load(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    a = e.select(F.col("user_id").alias("task_id"), n.cast("bigint").alias("attempt"), F.when(F.col("event_id") % 3 > 0, F.format_string("p%d", "event_id")).alias("code"), F.when(F.col("event_type") == "purchase", "success").otherwise("error").alias("status"))
    return code.solved(a).select("task_id", "attempt", "code", "status", F.size("previous").cast("bigint").alias("failed"))
