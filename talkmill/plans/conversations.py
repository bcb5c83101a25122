"""Queries over chats and messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions import text as tx
from talkmill.operators import conversations as ops
from talkmill.sources import tables as src

from .base import query

TERM = "ion"

_MESSAGES = "m AS (SELECT conv_id AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_id, role, text AS content FROM conversations)"
_PAIRS = """n AS (SELECT conv_id AS chat_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations),
r AS (SELECT chat_id, (pair - 1)::BIGINT AS response_idx, max(CASE WHEN role = 'user' THEN text END) AS query,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn), '') AS content FROM n WHERE pair > 0 GROUP BY ALL)"""
_NAMES = """named AS (SELECT chat_id, CASE WHEN length(t) > 32 THEN t[:32] || '…' ELSE t END AS name FROM
    (SELECT chat_id, coalesce(nullif(query, ''), content) AS t FROM r WHERE response_idx = 0))"""
_HITS = f"""h AS (SELECT chat_id, message_id, content, unnest(list_filter(range(length(content)), lambda i: substr(lower(content), (i + 1)::INT, {len(TERM)}) = '{TERM}')) AS pos
    FROM m WHERE contains(lower(content), '{TERM}')),
x AS (SELECT chat_id, message_id, pos, CASE WHEN pos > 30 THEN '...' ELSE '' END || substr(content, greatest(pos - 30, 0)::INT + 1, (least(length(content), pos + {len(TERM)} + 30) - greatest(pos - 30, 0))::INT)
    || CASE WHEN pos + {len(TERM)} + 30 < length(content) THEN '...' ELSE '' END AS excerpt FROM h)"""


@query("x1_chat_search", f"WITH {_MESSAGES}, {_PAIRS}, {_NAMES}, {_HITS} SELECT x.chat_id, name AS chat_name, message_id, pos::INT AS pos, excerpt FROM x LEFT JOIN named USING (chat_id)")
def chat_search(spark, sf):
    hits = ops.search(src.messages(spark, sf), TERM)
    names = ops.chat_names(src.responses(spark, sf)).withColumnRenamed("name", "chat_name")
    return hits.withColumnRenamed("at", "pos").join(names, "chat_id", "left").select("chat_id", "chat_name", "message_id", "pos", "excerpt")


@query("a7_search_by_chat", f"""WITH {_MESSAGES}, {_HITS} SELECT chat_id, count(*) AS n, string_agg(message_id || '@' || pos || ' ' || excerpt, chr(10) ORDER BY message_id, pos) AS hits FROM x GROUP BY ALL""")
def search_by_chat(spark, sf):
    grouped = ops.search_grouped(ops.search(src.messages(spark, sf), TERM))
    line = lambda h: F.concat(h["message_id"].cast("string"), F.lit("@"), h["at"].cast("string"), F.lit(" "), h["excerpt"])
    return grouped.select("chat_id", F.size("hits").cast("bigint").alias("n"), F.array_join(F.transform("hits", line), "\n").alias("hits"))


@query("x2_excerpt", f"WITH {_MESSAGES}, {_HITS} SELECT chat_id, message_id, pos::INT AS pos, excerpt FROM x")
def excerpts(spark, sf):
    return ops.search(src.messages(spark, sf), TERM).withColumnRenamed("at", "pos")


@query("p3_flatten_messages", f"""WITH {_PAIRS} SELECT chat_id, 2 * response_idx AS message_id, 'user' AS role, query AS content FROM r
UNION ALL SELECT chat_id, 2 * response_idx + 1, 'assistant', content FROM r""")
def flatten(spark, sf):
    return ops.flatten_messages(src.responses(spark, sf))


@query("p4_chat_name", f"WITH {_PAIRS}, {_NAMES} SELECT chat_id, name FROM named")
def chat_name(spark, sf):
    return ops.chat_names(src.responses(spark, sf))


@query("w3_message_index", f"WITH {_MESSAGES} SELECT chat_id, message_id, role, length(content) AS size FROM m")
def message_index(spark, sf):
    return src.messages(spark, sf).select("chat_id", "message_id", "role", F.length("content").cast("bigint").alias("size"))


@query("w5_turn_pairs", f"WITH {_PAIRS} SELECT * FROM r")
def turn_pairs(spark, sf):
    return src.responses(spark, sf)


_LISTED = "c AS (SELECT conv_id AS chat_id, conv_id % 10 AS session_id, max(turn) AS time_modified FROM conversations GROUP BY ALL)"


def _chats(spark, sf):
    names = ops.chat_names(src.responses(spark, sf))
    last = src.load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("chat_id")).agg(F.max("turn").alias("time_modified"))
    return last.join(names, "chat_id", "left").withColumns({"session_id": F.col("chat_id") % 10, "pos": F.col("chat_id")})


@query("p1_chat_listing", f"""WITH {_PAIRS}, {_NAMES}, {_LISTED} SELECT session_id, chat_id, name,
row_number() OVER (PARTITION BY session_id ORDER BY time_modified DESC, chat_id)::INT AS rank FROM c LEFT JOIN named USING (chat_id)""")
def chat_listing(spark, sf):
    return ops.list_chats(_chats(spark, sf))


@query("l1_chats_by_modified", f"WITH {_LISTED} SELECT chat_id, time_modified FROM c ORDER BY time_modified DESC, chat_id")
def chats_by_modified(spark, sf):
    return _chats(spark, sf).select("chat_id", "time_modified").orderBy(F.desc("time_modified"), "chat_id")


@query("j11_visible_chats", f"""WITH {_MESSAGES}, {_PAIRS}, {_NAMES}, {_HITS} SELECT chat_id, name FROM named
WHERE contains(lower(name), '{TERM}') OR chat_id IN (SELECT chat_id FROM x)""")
def visible(spark, sf):
    names = ops.chat_names(src.responses(spark, sf))
    return ops.visible_chats(names, ops.search(src.messages(spark, sf), TERM), f" {TERM.upper()} ")


@query("f12_route_messages", "SELECT event_id, user_id FROM events WHERE user_id = 7 OR event_type = 'error'")
def route(spark, sf):
    """Messages of the selected chat and those of no chat (errors stand for these)."""
    t = src.load(spark, sf, "events").withColumn("chat", F.when(F.col("event_type") != "error", F.col("user_id")))
    return t.filter(F.col("chat").isNull() | (F.col("chat") == 7)).select("event_id", "user_id")


@query("a10_joined_results", f"WITH {_MESSAGES} SELECT chat_id, string_agg(content, chr(10) || chr(10) ORDER BY message_id) AS output FROM m WHERE role = 'assistant' GROUP BY ALL")
def joined_results(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("message_id", "content")))
    t = src.messages(spark, sf).filter("role = 'assistant'")
    return t.groupBy("chat_id").agg(F.array_join(F.transform(parts, lambda m: m["content"]), "\n\n").alias("output"))


@query("n4_transcripts", f"WITH {_MESSAGES} SELECT chat_id, string_agg(role || ': ' || content, chr(10) ORDER BY message_id) AS transcript, count(*) AS n FROM m GROUP BY ALL")
def transcripts(spark, sf):
    return ops.transcripts(src.messages(spark, sf))


@query("a12_result_context", f"""WITH {_PAIRS}, t AS (SELECT chat_id, response_idx, query, content AS output,
    CASE WHEN response_idx % 3 = 2 THEN '' ELSE content END AS a, CASE WHEN response_idx % 3 = 2 THEN '0' ELSE 'ok' END AS b FROM r)
SELECT chat_id AS plan_id, 'Results:' || string_agg(chr(10) || 'Task: ' || query || chr(10) || 'Output: ' || output || chr(10)
    || CASE WHEN a NOT IN ('', '0') OR b NOT IN ('', '0') THEN 'Tool Results:' || chr(10) || '- find: ' || a || chr(10) || '- save: ' || b || chr(10) ELSE '' END, '' ORDER BY response_idx) AS context FROM t GROUP BY ALL""")
def context(spark, sf):
    last = F.col("response_idx") % 3 == 2
    tool = lambda n, r: F.struct(F.lit(n).alias("name"), r.alias("result"))
    t = src.responses(spark, sf).select(
        F.col("chat_id").alias("plan_id"), F.col("response_idx").alias("pos"), F.col("query").alias("task"), F.col("content").alias("output"),
        F.array(tool("find", F.when(last, F.lit("")).otherwise(F.col("content"))), tool("save", F.when(last, F.lit("0")).otherwise(F.lit("ok")))).alias("tools"),
    )
    return ops.result_context(t, "Results:")


@query("l8_last_messages", f"WITH {_MESSAGES} SELECT chat_id, string_agg(message_id::VARCHAR, ',' ORDER BY message_id) AS ids FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY message_id DESC) <= 3) GROUP BY ALL")
def last_messages(spark, sf):
    last = ops.last_messages(src.messages(spark, sf), 3)
    return last.groupBy("chat_id").agg(F.array_join(F.array_sort(F.collect_list("message_id")).cast("array<string>"), ",").alias("ids"))


@query("x4_truncated", "SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || ' [...]' ELSE text END AS short FROM documents")
def truncated(spark, sf):
    return src.load(spark, sf, "documents").select("doc_id", tx.truncated(F.col("text"), 30, " [...]").alias("short"))


@query("x36_display_name", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), c_custkey::VARCHAR) AS shown FROM customer")
def display_name(spark, sf):
    t = src.load(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_name"))
    return t.select("c_custkey", tx.display_name(name, F.col("c_custkey").cast("string")).alias("shown"))


@query("w2_tool_ids", f"WITH {_MESSAGES} SELECT chat_id, message_id, chat_id || '/' || (row_number() OVER (PARTITION BY chat_id ORDER BY message_id) - 1) AS tool_id FROM m WHERE role = 'assistant'")
def tool_ids(spark, sf):
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("message_id")) - 1
    t = src.messages(spark, sf).filter("role = 'assistant'")
    return t.select("chat_id", "message_id", F.concat_ws("/", F.col("chat_id").cast("string"), n.cast("string")).alias("tool_id"))
