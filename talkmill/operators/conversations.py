"""Chats and messages: flattening, pairing, naming, listing, search and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions import text as tx


def pair_turns(turns: DataFrame) -> DataFrame:
    """(chat_id, response_idx, query, content): each user turn with the assistant's text up to the next one.

    Turns before the first user turn and other roles' turns belong to no pair.
    """
    w = Window.partitionBy("chat_id").orderBy("turn")
    numbered = turns.withColumn("pair", F.sum((F.col("role") == "user").cast("int")).over(w)).filter("pair > 0")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "content"))))
    return numbered.groupBy("chat_id", "pair").agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("query"),
        F.array_join(F.transform(said, lambda s: s["content"]), "\n").alias("content"),
    ).select("chat_id", (F.col("pair") - 1).cast("bigint").alias("response_idx"), "query", "content")


def flatten_messages(responses: DataFrame) -> DataFrame:
    """Two messages a response, ids 2i (user) and 2i + 1 (assistant); empty ones too."""
    two = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), "content"))
    return responses.select("chat_id", "response_idx", F.explode(two).alias("m")).select(
        "chat_id", (2 * F.col("response_idx") + F.col("m.k")).cast("bigint").alias("message_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def derived_name(query: Column, content: Column) -> Column:
    """The query, or without one the content, cut at 32 characters."""
    return tx.truncated(F.coalesce(F.nullif(query, F.lit("")), content), 32)


def chat_names(responses: DataFrame) -> DataFrame:
    """Each chat's name by its first response."""
    first = F.min_by(derived_name(F.col("query"), F.col("content")), F.col("response_idx"))
    return responses.groupBy("chat_id").agg(first.alias("name"))


def list_chats(chats: DataFrame, session: str = "session_id") -> DataFrame:
    """Without bodies, the last modified first in each session; ``pos`` breaks ties, as a stable sort does."""
    order = Window.partitionBy(session).orderBy(F.desc("time_modified"), F.asc("pos"))
    return chats.select(session, "chat_id", "name", F.row_number().over(order).alias("rank"))


def search(messages: DataFrame, query: str, context: int = 30) -> DataFrame:
    """One row per place of the query, also overlapping ones, with its excerpt."""
    hits = messages.filter(F.contains(F.lower("content"), F.lit(query.lower()))) if query else messages.limit(0)
    found = hits.select("chat_id", "message_id", F.explode(tx.excerpts(F.col("content"), query, context)).alias("h"))
    return found.select("chat_id", "message_id", "h.at", "h.excerpt")


def search_grouped(hits: DataFrame) -> DataFrame:
    """Hits of a chat as one array in message order."""
    each = F.struct("message_id", "at", "excerpt")
    return hits.groupBy("chat_id").agg(F.array_sort(F.collect_list(each)).alias("hits"))


def visible_chats(chats: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Chats whose name holds the trimmed query or that have hits; all of them for an empty query."""
    q = query.strip().lower()
    if not q:
        return chats
    found = hits.select("chat_id").distinct().withColumn("_hit", F.lit(True))
    return chats.join(found, "chat_id", "left").filter(F.contains(F.lower("name"), F.lit(q)) | F.col("_hit")).drop("_hit")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each chat: Spark keeps n a chat on the map side already."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("message_id"))
    return messages.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n).drop("_back")


def transcripts(messages: DataFrame) -> DataFrame:
    """Each chat as ``role: content`` lines in order, with its number of messages."""
    lines = F.array_sort(F.collect_list(F.struct("message_id", "role", "content")))
    line = lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))
    return messages.groupBy("chat_id").agg(F.array_join(F.transform(lines, line), "\n").alias("transcript"), F.count(F.lit(1)).alias("n"))


def result_context(results: DataFrame, heading: str = "") -> DataFrame:
    """Ordered text of tasks, outputs and tool results by plan; tools only where some result says something.

    results: plan_id, pos, task, output, tools array<struct<name, result>>.
    """
    truthy = lambda t: F.coalesce(~t["result"].isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))
    lines = F.array_join(F.transform("tools", lambda t: F.concat(F.lit("- "), t["name"], F.lit(": "), F.coalesce(t["result"], F.lit("None")), F.lit("\n"))), "")
    tools = F.when(F.exists("tools", truthy), F.concat(F.lit("Tool Results:\n"), lines)).otherwise("")
    block = F.concat(F.lit("\nTask: "), "task", F.lit("\nOutput: "), "output", F.lit("\n"), tools)
    parts = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))
    return results.groupBy("plan_id").agg(F.concat(F.lit(heading), F.array_join(F.transform(parts, lambda p: p["b"]), "")).alias("context"))
