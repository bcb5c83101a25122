"""Result files of evaluation runs: nested JSON by method and model, read into tables and written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = """struct<question: string, response: string, iterations: int, time: double, server_time: double, score: int, agent_time: map<string, double>,
response_metadata: map<string, bigint>, tool_matches: struct<match: array<string>, missed: array<string>, extra: array<string>>>"""
SUMMARY = """struct<questions: bigint, correct_tool_usage: bigint, perfect_tool_usage: bigint, total_time: double, total_server_time: double,
agent_time: map<string, double>, total_token_usage: bigint, average_score: double>"""
FILE = f"map<string, map<string, struct<questions: array<{QUESTION}>, summary: {SUMMARY}>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: method, model, questions and summary."""
    runs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", FILE)).alias("method", "models"))
    return runs.select("method", F.explode("models").alias("model", "run")).select("method", "model", "run.questions", "run.summary")


def summaries(results: DataFrame) -> DataFrame:
    """Runs in the columns that comparisons take."""
    s = "summary"
    return results.select(
        "method", "model", f"{s}.questions", F.col(f"{s}.correct_tool_usage").alias("correct"), F.col(f"{s}.perfect_tool_usage").alias("perfect"),
        F.col(f"{s}.total_token_usage").alias("tokens"), F.col(f"{s}.total_time").alias("time"), F.col(f"{s}.total_server_time").alias("server_time"), f"{s}.average_score",
    )


def answers(results: DataFrame) -> DataFrame:
    """One row per question of every run, in the columns that summaries are made of."""
    q = results.select("method", "model", F.posexplode("questions").alias("pos", "q"))
    return q.select(
        "method", "model", "pos", F.size("q.tool_matches.missed").alias("missed"), F.size("q.tool_matches.extra").alias("extra"),
        F.coalesce(F.try_element_at("q.response_metadata", F.lit("total_tokens")), F.lit(0)).alias("tokens"), "q.time", "q.server_time", "q.score", "q.agent_time",
    )


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in place of whatever was there, so a file never holds two reports."""
    rows.write.mode("overwrite").json(path)
