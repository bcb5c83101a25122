"""Folding typed messages into texts, metrics and status: each fold over batches and over streams.

The messages of one chat platform are one table with a ``type`` and nullable columns (``SCHEMA``). Order is by
``seq``; ``event_ts`` is the event time of watermarks. A stream run to its end gives what the batch fold gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from talkmill.operators import evaluation

SCHEMA = """seq bigint, event_ts timestamp, type string, chat_id string, id string, agent string, chunk string, is_output boolean,
name string, args string, result string, status string, completed boolean, input_tokens bigint, total_tokens bigint, execution_time double, task_id bigint"""

CHUNK, RESET, CALL, RESULT, STATUS, METRICS = "TextChunkMessage", "ResetTextMessage", "ToolCallMessage", "ToolResultMessage", "StatusMessage", "MetricsMessage"


def _is(*kinds: str):
    return F.col("type").isin(*kinds)


def for_chat(messages: DataFrame, chat_id: str) -> DataFrame:
    """Messages of the chat, and those of no chat."""
    return messages.filter(F.col("chat_id").isNull() | (F.col("chat_id") == chat_id))


def texts(messages: DataFrame) -> DataFrame:
    """The answer text of each chat: output chunks in order, from the last reset on."""
    last = messages.filter(_is(RESET)).groupBy("chat_id").agg(F.max("seq").alias("reset"))
    chunks = messages.filter(_is(CHUNK) & F.col("is_output")).join(last, "chat_id", "left").filter("reset IS NULL OR seq > reset")
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    text = chunks.groupBy("chat_id").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("text"))
    every = messages.filter(_is(RESET) | _is(CHUNK) & F.col("is_output")).select("chat_id").distinct()
    return every.join(text, "chat_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def _fold_text(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, seen = state.get if state.exists else ("", -1)
    for m in pd.concat(batches).sort_values("seq").itertuples():
        if m.seq <= seen:  # a replayed message
            continue
        text, seen = ("" if m.type == RESET else text + m.chunk), m.seq
    state.update((text, seen))
    yield pd.DataFrame({"chat_id": [key[0]], "text": [text], "seq": [seen]})


def stream_texts(messages: DataFrame) -> DataFrame:
    """The same over a stream, in update mode: a chat's new text whenever it changes. Messages of a chat come in
    order of ``seq`` from batch to batch; those that were seen already are passed over."""
    told = messages.filter(_is(RESET) | _is(CHUNK) & F.col("is_output"))
    return told.groupBy("chat_id").applyInPandasWithState(_fold_text, "chat_id string, text string, seq bigint", "text string, seq bigint", "update", GroupStateTimeout.NoTimeout)


def debug_texts(messages: DataFrame) -> DataFrame:
    """Chunks joined by id, where each message without an id stands alone; at the place of the first one."""
    key = F.coalesce("id", F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    t = messages.filter(_is(CHUNK) & (F.coalesce("chunk", F.lit("")) != ""))
    return t.groupBy("chat_id", key.alias("k")).agg(F.min("seq").alias("seq"), F.first("id", ignorenulls=True).alias("id"), F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("text")).drop("k")


def replaced_texts(messages: DataFrame) -> DataFrame:
    """The last text of each id; messages without an id stand alone."""
    key = F.coalesce("id", F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    t = messages.filter(F.coalesce("chunk", F.lit("")) != "")
    return t.groupBy("chat_id", key.alias("k")).agg(F.min("seq").alias("seq"), F.first("id", ignorenulls=True).alias("id"), F.max_by("chunk", "seq").alias("text")).drop("k")


def agent_metrics(messages: DataFrame) -> DataFrame:
    """Messages, tokens and time by chat and agent; over a stream in update or complete mode."""
    return evaluation.agent_metrics(messages.filter(_is(METRICS)), "chat_id")


def paired_calls(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tool calls with their results by id. Over a stream both sides wait ``delay`` for each other, and calls
    without a result come out once the watermark has passed them."""
    calls = messages.filter(_is(CALL)).select("chat_id", F.col("id").alias("call_id"), "name", "args", F.col("event_ts").alias("called"))
    results = messages.filter(_is(RESULT)).select(F.col("chat_id").alias("r_chat"), F.col("id").alias("r_id"), "result", F.col("event_ts").alias("answered"))
    if messages.isStreaming:
        calls, results = calls.withWatermark("called", delay), results.withWatermark("answered", delay)
    near = (F.col("answered") >= F.col("called") - F.expr(f"INTERVAL {delay}")) & (F.col("answered") <= F.col("called") + F.expr(f"INTERVAL {delay}"))
    on = (F.col("chat_id") == F.col("r_chat")) & (F.col("call_id") == F.col("r_id")) & near
    return calls.join(results, on, "left").select("chat_id", "call_id", "name", "args", "result")


def statuses(messages: DataFrame) -> DataFrame:
    """The last status of each agent of a chat. It is done if it said so, or once another agent has come up since."""
    s = messages.filter(_is(STATUS) & (F.trim(F.coalesce("status", F.lit(""))) != ""))
    each = s.groupBy("chat_id", "agent").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by(F.trim("status"), "seq").alias("text"), F.max_by(F.coalesce("completed", F.lit(False)), "seq").alias("said")
    )
    newest = each.groupBy("chat_id").agg(F.max("first").alias("newest"))
    return each.join(newest, "chat_id").select("chat_id", "agent", "text", (F.col("said") | (F.col("newest") > F.col("last"))).alias("completed"))


def replayed(responses: DataFrame) -> DataFrame:
    """Stored responses as the messages that a client would have received.

    responses: chat_id, response_idx, content, agent_messages array<struct<id, agent, execution_time, input_tokens,
    total_tokens, tools array<struct<id, name, args, result>>>>. Each response resets the text before its chunk.
    """
    one = lambda kind, **c: F.struct(F.lit(kind).alias("type"), *((c[k] if k in c else F.lit(None)).cast(t).alias(k) for k, t in _FIELDS))
    tool = lambda a: lambda t: F.array(
        one(CALL, id=t["id"], agent=a["agent"], name=t["name"], args=t["args"]), one(RESULT, id=t["id"], agent=a["agent"], result=t["result"])
    )
    of_agent = lambda a: F.concat(
        F.flatten(F.transform(a["tools"], tool(a))),
        F.array(one(METRICS, id=a["id"], agent=a["agent"], input_tokens=a["input_tokens"], total_tokens=a["total_tokens"], execution_time=a["execution_time"])),
    )
    text = F.array(one(RESET), one(CHUNK, chunk=F.col("content"), is_output=F.lit(True)))
    m = responses.select("chat_id", "response_idx", F.posexplode(F.concat(F.flatten(F.transform("agent_messages", of_agent)), text)).alias("n", "m"))
    return m.select((F.col("response_idx") * 1_000_000 + F.col("n")).cast("bigint").alias("seq"), "chat_id", "m.*")


_FIELDS = [("id", "string"), ("agent", "string"), ("chunk", "string"), ("is_output", "boolean"), ("name", "string"), ("args", "string"), ("result", "string"), ("input_tokens", "bigint"), ("total_tokens", "bigint"), ("execution_time", "double")]


#: The types of a model's events; ``ABORTED`` is the user's.
DELTA, COMPLETED, FAILED, ABORTED = "response.output_text.delta", "response.completed", "response.failed", "aborted"


def _until_end(events: DataFrame) -> DataFrame:
    """The events before each message's end, which its first failed or aborted one is, and that one's seq as ``_end``.

    A message that only wants tool calls stops at its first text, before anything of it counts.
    """
    ends = _is(FAILED, ABORTED) | (_is(DELTA) & F.coalesce("tools_only", F.lit(False)))
    end = events.groupBy("chat_id", "message_id").agg(F.min(F.when(ends, F.col("seq"))).alias("_end"))
    return events.join(end, ["chat_id", "message_id"]).filter("_end IS NULL OR seq <= _end")


def model_messages(events: DataFrame) -> DataFrame:
    """What a model's events make of each message: its text, state, error, token usage and time.

    events: chat_id, message_id, agent, seq, at (timestamp), type, delta, tools_only, calls (array<struct<name, arguments>>),
    usage (map<string, bigint>), error (struct<code, message>), wants (array<string>, the fields of a structured reply, or null).
    state: completed, failed, aborted, stopped (at a text where only tools were wanted), unparsable (a structured
    reply that is no JSON object with its fields), or open.
    """
    e = _until_end(events)
    before = F.col("_end").isNull() | (F.col("seq") < F.col("_end"))
    parts = F.array_sort(F.collect_list(F.when(before & _is(DELTA), F.struct("seq", F.coalesce("delta", F.lit("")).alias("d")))))
    last = F.when(before & _is(COMPLETED), F.col("seq"))
    ended = F.max_by("type", F.when(F.col("seq") == F.col("_end"), F.col("seq")))
    m = e.groupBy("chat_id", "message_id").agg(
        F.min_by("agent", "seq").alias("agent"), F.array_join(F.transform(parts, lambda p: p["d"]), "").alias("content"), ended.alias("_ended"),
        F.max_by("error", F.when(_is(FAILED), F.col("seq"))).alias("_error"), F.max(last).alias("_done"), F.max_by("usage", last).alias("usage"), F.max_by("wants", last).alias("_wants"),
        ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / F.lit(1e6)).alias("execution_time"),
    )
    fields = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    fits = F.col("_wants").isNull() | (F.try_parse_json("content").isNotNull() & (F.size(F.array_except("_wants", fields)) == 0))
    state = (
        F.when(F.col("_ended") == FAILED, "failed").when(F.col("_ended") == ABORTED, "aborted").when(F.col("_ended") == DELTA, "stopped")
        .when(F.col("_done").isNull(), "open").when(~fits, "unparsable").otherwise("completed")
    )
    error = F.when(state == "failed", F.concat_ws(": ", "_error.code", "_error.message"))
    return m.select("chat_id", "message_id", "agent", "content", state.alias("state"), error.alias("error"), "usage", "execution_time")


def model_calls(events: DataFrame) -> DataFrame:
    """The tool calls of completed events: tool_id (numbered through the chat's messages), name and args.

    Calls without a name are passed over; arguments that are no JSON become an empty object.
    """
    e = _until_end(events).filter(_is(COMPLETED) & (F.col("_end").isNull() | (F.col("seq") < F.col("_end"))))
    calls = e.select("chat_id", "message_id", "agent", "seq", F.posexplode("calls").alias("pos", "c")).filter("c.name IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("seq", "pos")) - 1
    args = F.when(F.try_parse_json("c.arguments").isNotNull(), F.col("c.arguments")).otherwise("{}")
    return calls.select("chat_id", "message_id", "agent", F.concat_ws("/", "message_id", n.cast("string")).alias("tool_id"), F.col("c.name").alias("name"), args.alias("args"))


def inbound(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The messages that arrive as JSON lines in a folder, as a stream."""
    return spark.readStream.schema(schema).json(folder)


def outbox(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that keeps each micro-batch in a folder of its own: one that is sent again
    overwrites itself, so with the stream's checkpoint every message arrives once, tagged by its type."""

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return send


def latest(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that keeps the last micro-batch only, as complete outputs want it."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return keep


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream into a sink until all that is there has passed; called again it goes on where it stopped."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def persist_every(state: DataFrame, folder: str, checkpoint: str, seconds: int = 60):
    """Starts the periodic write of a stream's state (expired rows are for the caller to filter)."""
    return state.writeStream.outputMode("update").foreachBatch(outbox(folder)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
