"""Question corpora of evaluations: JSON lines with the calls that a right answer makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARGUMENT = "struct<key: string, value: string, match: string, optional: boolean>"
CALL = f"struct<id: int, name: string, optional: boolean, depends: array<int>, alternatives: array<array<int>>, args: array<{ARGUMENT}>>"
CORPUS = f"set string, question_id bigint, input string, output string, tools array<{CALL}>"


def read_questions(spark: SparkSession, folder: str, *sets: str) -> DataFrame:
    """The questions of some sets, or of all; values of arguments are JSON texts."""
    rows = spark.read.schema(CORPUS).json(folder)
    return rows.filter(F.col("set").isin(*sets)) if sets else rows


def expected_calls(questions: DataFrame) -> DataFrame:
    """One row per call that a question expects, in the columns of the matching."""
    each = questions.select("set", "question_id", F.posexplode("tools").alias("pos", "t"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    args = F.transform("t.args", lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"), F.coalesce(a["match"], F.lit("exact")).alias("match"), flag(a["optional"]).alias("optional")))
    return each.select("set", "question_id", "pos", F.coalesce("t.id", F.lit(-1)).alias("id"), "t.name", flag(F.col("t.optional")).alias("optional"), "t.depends", "t.alternatives", args.alias("args"))
