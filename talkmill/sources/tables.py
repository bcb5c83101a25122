"""The driver's tables as the relations of a chat platform.

Column names of the canonical relations: messages (chat_id, message_id, role, content), responses
(chat_id, response_idx, query, content), metrics (agent, chat_id, seq, at, execution_time, tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` turns, numbered from 0 in each chat."""
    t = load(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.select(F.col("conv_id").alias("chat_id"), pos.cast("bigint").alias("message_id"), "role", F.col("text").alias("content"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user turn and the assistant turns up to the next one (joined by line breaks)."""
    from talkmill.operators.conversations import pair_turns

    return pair_turns(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as metric messages: the type is the agent, ``props.k`` the tokens; every third lacks them."""
    t = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.select(
        F.col("event_type").alias("agent"), F.col("user_id").alias("chat_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        F.col("value").alias("execution_time"), F.when(F.col("event_id") % 3 != 0, k).alias("input_tokens"), (k * 2 + F.col("event_id") % 5).alias("total_tokens"),
    )
