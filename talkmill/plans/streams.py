"""Queries over message folds, with ``events`` as messages of the chat user_id in order of event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.sources.shared import own_folder
from talkmill.sources.tables import load
from talkmill.streaming import fold

from .base import query


def _messages(e):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    when = lambda t, c: F.when(F.col("type") == t, c)
    m = e.withColumn(
        "type", F.when(kind == "view", fold.CHUNK).when(kind == "error", fold.RESET).when(kind == "click", fold.METRICS).when(kind == "signup", fold.STATUS).otherwise(fold.CALL)
    )
    return m.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_ts"), "type", F.col("user_id").cast("string").alias("chat_id"),
        F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 11).cast("string")).alias("id"), F.concat(F.lit("a"), (F.col("event_id") % 4).cast("string")).alias("agent"),
        when(fold.CHUNK, F.concat(F.col("event_id").cast("string"), F.lit(","))).alias("chunk"), (F.col("event_id") % 5 > 0).alias("is_output"),
        F.concat(F.lit(" s"), F.col("event_id").cast("string")).alias("status"), F.lit(False).alias("completed"),
        when(fold.METRICS, k).alias("input_tokens"), when(fold.METRICS, 3 * k).alias("total_tokens"), F.col("value").alias("execution_time"),
    )


@query("t1_chat_texts", """WITH l AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id::VARCHAR AS chat_id, coalesce(string_agg(event_id || ',', '' ORDER BY event_id) FILTER (event_type = 'view' AND (r IS NULL OR event_id > r)), '') AS text
FROM events LEFT JOIN l USING (user_id) WHERE event_type = 'error' OR (event_type = 'view' AND event_id % 5 > 0) GROUP BY ALL""")
def chat_texts(spark, sf):
    """With resets (T2): only what follows a chat's last one stands."""
    return fold.texts(_messages(load(spark, sf, "events")))


_KEY = "coalesce(CASE WHEN event_id % 3 > 0 THEN (event_id % 11)::VARCHAR END, 'n' || event_id)"


@query("t3_debug_texts", f"""SELECT user_id::VARCHAR AS chat_id, min(event_id) AS seq, string_agg(event_id || ',', '' ORDER BY event_id) AS text FROM events WHERE event_type = 'view' GROUP BY user_id, {_KEY}""")
def debug_texts(spark, sf):
    return fold.debug_texts(_messages(load(spark, sf, "events"))).select("chat_id", "seq", "text")


@query("t4_replaced_texts", f"""SELECT user_id::VARCHAR AS chat_id, min(event_id) AS seq, max(event_id) || ',' AS text FROM events WHERE event_type = 'view' GROUP BY user_id, {_KEY}""")
def replaced_texts(spark, sf):
    return fold.replaced_texts(_messages(load(spark, sf, "events"))).select("chat_id", "seq", "text")


def _live(spark, sf):
    return _messages(spark.readStream.schema(load(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]"))  # a pattern, as a stream takes no single file


_METRICS = """SELECT 'a' || event_id % 4 AS agent, user_id::VARCHAR AS chat_id, count(*) AS count, sum(k)::BIGINT AS tokens_in, sum(2 * k)::BIGINT AS tokens_out, round(sum(value), 4) AS execution_time
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) WHERE event_type = 'click' GROUP BY ALL"""


@query("t5_agent_metrics", _METRICS)
def agent_metrics(spark, sf):
    return fold.agent_metrics(_messages(load(spark, sf, "events"))).withColumn("execution_time", F.round("execution_time", 4))


@query("t5_streamed_agent_metrics", _METRICS)
def streamed_agent_metrics(spark, sf):
    """The same fold over a stream that reads what there is, in complete mode."""
    live = _live(spark, sf)
    folder = own_folder(spark, "t5")
    fold.drained(fold.agent_metrics(live), fold.latest(f"{folder}/state"), f"{folder}/check", "complete")
    return spark.read.parquet(f"{folder}/state").withColumn("execution_time", F.round("execution_time", 4))


@query("t6_paired_calls", """SELECT c.user_id::VARCHAR AS chat_id, c.event_id::VARCHAR AS call_id, r.event_id::VARCHAR AS result FROM events AS c
LEFT JOIN events AS r ON r.user_id = c.user_id AND r.event_id = c.event_id + 150 AND r.event_type = 'view' AND abs(epoch_us(r.ts) - epoch_us(c.ts)) <= 864e9 WHERE c.event_type = 'purchase'""")
def paired_calls(spark, sf):
    e = load(spark, sf, "events")
    at = F.col("ts").cast("timestamp").alias("event_ts")
    calls = e.filter("event_type = 'purchase'").select(F.lit(fold.CALL).alias("type"), F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").cast("string").alias("id"), at, F.lit("").alias("result"))
    results = e.filter("event_type = 'view'").select(F.lit(fold.RESULT).alias("type"), F.col("user_id").cast("string").alias("chat_id"), (F.col("event_id") - 150).cast("string").alias("id"), at, F.col("event_id").cast("string").alias("result"))
    both = calls.unionByName(results).withColumns({"name": F.lit(""), "args": F.lit("")})
    return fold.paired_calls(both, "10 days").select("chat_id", "call_id", "result")


@query("t7_statuses", """WITH s AS (SELECT user_id::VARCHAR AS chat_id, 'a' || event_id % 4 AS agent, min(event_id) AS f, max(event_id) AS l FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT chat_id, agent, 's' || l AS text, max(f) OVER (PARTITION BY chat_id) > l AS completed FROM s""")
def statuses(spark, sf):
    return fold.statuses(_messages(load(spark, sf, "events")))


def _responses(spark, sf):
    c = load(spark, sf, "conversations").filter("role = 'assistant'")
    tool = F.struct(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("find").alias("name"), F.lit("{}").alias("args"), F.col("text").alias("result"))
    a = F.struct(
        F.lit("m").alias("id"), F.concat(F.lit("agent"), (F.col("turn") % 3).cast("string")).alias("agent"), F.lit(0.5).cast("double").alias("execution_time"),
        F.col("turn").alias("input_tokens"), (F.col("turn") + 7).alias("total_tokens"), F.array(tool).alias("tools"),
    )
    return c.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("response_idx"), F.col("text").alias("content"), F.array(a).alias("agent_messages"))


@query("t13_replayed_texts", "SELECT conv_id::VARCHAR AS chat_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL")
def replayed_texts(spark, sf):
    return fold.texts(fold.replayed(_responses(spark, sf)))


@query("t13_replayed_metrics", "SELECT conv_id::VARCHAR AS chat_id, 'agent' || turn % 3 AS agent, count(*) AS count, sum(turn)::BIGINT AS tokens_in, sum(7)::BIGINT AS tokens_out, sum(0.5)::DOUBLE AS execution_time FROM conversations WHERE role = 'assistant' GROUP BY ALL")
def replayed_metrics(spark, sf):
    return fold.agent_metrics(fold.replayed(_responses(spark, sf)))


_TYPED = """SELECT event_id AS seq, user_id::VARCHAR AS chat_id, CASE event_type WHEN 'view' THEN 'TextChunkMessage' WHEN 'error' THEN 'ResetTextMessage' WHEN 'click' THEN 'MetricsMessage' WHEN 'signup' THEN 'StatusMessage' ELSE 'ToolCallMessage' END AS type FROM events"""


@query("k4_sent_messages", _TYPED)
def sent(spark, sf):
    """The messages as a stream sends them, each tagged by its type; one micro-batch is sent again and overwrites itself."""
    folder = own_folder(spark, "k4")
    fold.drained(_live(spark, sf).select("seq", "chat_id", "type"), fold.outbox(f"{folder}/sent"), f"{folder}/check")
    fold.outbox(f"{folder}/sent")(_messages(load(spark, sf, "events")).select("seq", "chat_id", "type"), 0)
    return spark.read.parquet(f"{folder}/sent").select("seq", "chat_id", "type")


@query("t8_replayed_outbox", _TYPED)
def replayed_outbox(spark, sf):
    """Nobody is connected at first: the messages wait in the outbox's batches, and are replayed in order, once."""
    folder = own_folder(spark, "t8")
    live = _live(spark, sf).select("seq", "chat_id", "type")
    fold.drained(live, fold.outbox(f"{folder}/sent"), f"{folder}/check")
    fold.drained(live, fold.outbox(f"{folder}/sent"), f"{folder}/check")  # connected again: nothing new, nothing twice
    return spark.read.parquet(f"{folder}/sent").orderBy("batch", "seq").select("seq", "chat_id", "type")


@query("t10_persisted_metrics", _METRICS)
def persisted(spark, sf):
    """The state that a periodic write keeps; of each key the last batch counts."""
    folder = own_folder(spark, "t10")
    q = fold.persist_every(fold.agent_metrics(_live(spark, sf)), f"{folder}/state", f"{folder}/check", seconds=0)
    q.processAllAvailable()
    q.stop()
    state = spark.read.parquet(f"{folder}/state")
    rest = F.struct(*[c for c in state.columns if c not in ("agent", "chat_id", "batch")])
    last = state.groupBy("agent", "chat_id").agg(F.max_by(rest, "batch").alias("r")).select("agent", "chat_id", "r.*")
    return last.withColumn("execution_time", F.round("execution_time", 4))


@query("s10_inbound_messages", "SELECT event_id AS seq, user_id::VARCHAR AS chat_id, event_type AS type FROM events WHERE event_type <> 'error'")
def inbound(spark, sf):
    """Messages that arrive as JSON lines, as a stream; those of an unknown type are passed over."""
    folder = own_folder(spark, "s10")
    rows = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("chat_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"))
    rows.write.json(f"{folder}/queue")
    stream = fold.inbound(spark, f"{folder}/queue", "seq bigint, chat_id string, type string").filter("type IS NOT NULL")
    fold.drained(stream, fold.outbox(f"{folder}/got"), f"{folder}/check")
    return spark.read.parquet(f"{folder}/got").select("seq", "chat_id", "type")


def _model_events(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", fold.COMPLETED).when((F.col("event_type") == "error") & (k % 7 == 0), fold.ABORTED).when((F.col("event_type") == "error") & (k % 3 == 0), fold.FAILED)
    call = lambda name, args: F.struct(name.alias("name"), args.alias("arguments"))
    calls = F.array(call(F.when(k % 4 > 0, F.concat(F.lit("t"), (k % 4).cast("string"))), F.when(k % 3 == 0, F.lit("no json")).otherwise(F.format_string('{"x":%d}', k))), call(F.lit("last"), F.lit("{}")))
    return e.select(
        F.col("user_id").cast("string").alias("chat_id"), F.concat_ws("-", F.col("user_id").cast("string"), (k % 2).cast("string")).alias("message_id"), F.lit("assistant").alias("agent"), k.alias("seq"),
        F.col("ts").cast("timestamp").alias("at"), F.coalesce(kind, F.lit(fold.DELTA)).alias("type"), F.when(kind.isNull(), F.concat(k.cast("string"), F.lit(" "))).alias("delta"),
        (F.col("user_id") % 11 == 0).alias("tools_only"), F.when(kind == fold.COMPLETED, calls).alias("calls"), F.when(kind == fold.COMPLETED, F.create_map(F.lit("total_tokens"), k)).alias("usage"),
        F.struct(F.lit("e1").alias("code"), k.cast("string").alias("message")).alias("error"), F.when(F.col("user_id") % 13 == 0, F.array(F.lit("reason"))).alias("wants"),
    )


_MODEL = """e AS (SELECT user_id, event_id AS seq, user_id || '-' || event_id % 2 AS message_id, ts, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'aborted' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' ELSE 'delta' END AS kind FROM events),
c AS (SELECT *, min(CASE WHEN kind IN ('aborted', 'failed') OR (kind = 'delta' AND user_id % 11 = 0) THEN seq END) OVER (PARTITION BY message_id) AS stop FROM e)"""


@query("t9_model_messages", f"""WITH {_MODEL} SELECT user_id::VARCHAR AS chat_id, message_id, coalesce(string_agg(seq || ' ', '' ORDER BY seq) FILTER (kind = 'delta' AND (stop IS NULL OR seq < stop)), '') AS content,
CASE max(kind) FILTER (seq = stop) WHEN 'failed' THEN 'failed' WHEN 'aborted' THEN 'aborted' WHEN 'delta' THEN 'stopped' ELSE CASE WHEN count(*) FILTER (kind = 'done') = 0 THEN 'open' WHEN user_id % 13 = 0 THEN 'unparsable' ELSE 'completed' END END AS state,
CASE WHEN max(kind) FILTER (seq = stop) = 'failed' THEN 'e1: ' || max(stop) END AS error, max(seq) FILTER (kind = 'done' AND (stop IS NULL OR seq < stop)) AS total_tokens,
round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS execution_time FROM c WHERE stop IS NULL OR seq <= stop GROUP BY user_id, message_id""")
def model_messages(spark, sf):
    m = fold.model_messages(_model_events(spark, sf))
    return m.select("chat_id", "message_id", "content", "state", "error", F.try_element_at("usage", F.lit("total_tokens")).alias("total_tokens"), F.round("execution_time", 3).alias("execution_time"))


@query("t9_model_calls", f"""WITH {_MODEL}, d AS (SELECT *, unnest([0, 1]) AS pos FROM c WHERE kind = 'done' AND (stop IS NULL OR seq < stop))
SELECT user_id::VARCHAR AS chat_id, message_id, message_id || '/' || (row_number() OVER (PARTITION BY user_id ORDER BY seq, pos) - 1) AS tool_id, CASE pos WHEN 0 THEN 't' || seq % 4 ELSE 'last' END AS name,
CASE WHEN pos = 1 OR seq % 3 = 0 THEN '{{}}' ELSE '{{"x":' || seq || '}}' END AS args FROM d WHERE pos = 1 OR seq % 4 > 0""")
def model_calls(spark, sf):
    return fold.model_calls(_model_events(spark, sf)).drop("agent")
