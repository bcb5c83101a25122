"""Running programs elsewhere: what a sandbox is asked, what becomes of its answers, and repeated attempts.

Nothing here runs a program; the sandbox's answers are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import returned

#: Seconds that an answer may be late, and a program's memory.
GRACE_S, MEMORY_MB = 5, 1024


def requests(programs: DataFrame, timeout_s: int = 10) -> DataFrame:
    """What the sandbox is asked for programs (run_id, code): the program with its last expression bound, and its limits."""
    limits = (F.lit(timeout_s).alias("timeout_s"), F.lit(timeout_s + GRACE_S).alias("deadline_s"), F.lit(MEMORY_MB).alias("memory_mb"))
    return returned(programs.select("run_id", "code"), "run_id").select("run_id", "code", *limits)


def executed(asked: DataFrame, answers: DataFrame, *more: str) -> DataFrame:
    """run_id, status, stdout and stderr of every request, and more of its columns. answers: run_id, status, stdout, stderr,
    seconds, used_mb.

    An answer that is late or missing is a timeout, one of a program beyond its memory an error; both lose their output.
    """
    r = asked.join(answers, "run_id", "left")
    late = F.col("seconds").isNull() | (F.col("seconds") > F.col("deadline_s"))
    state = F.when(late, "timeout").when(F.col("used_mb") > F.col("memory_mb"), "error").otherwise(F.col("status"))
    kept = lambda c: F.when(~late & (F.coalesce("used_mb", F.lit(0)) <= F.col("memory_mb")), F.col(c))
    return r.select("run_id", *more, state.alias("status"), kept("stdout").alias("stdout"), kept("stderr").alias("stderr"))


def solved(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """By task its first successful attempt, else the last that the retries allow, and what went before.

    attempts: task_id, attempt (from 1), code, status. An attempt without code is a failed one. Attempts after a
    success, or beyond the retries, were never made.
    """
    shown = F.when(F.coalesce("code", F.lit("")) == "", F.lit("no code")).otherwise(F.col("status"))
    a = attempts.filter(F.col("attempt") <= max_retries + 1).select("task_id", "attempt", F.nullif("code", F.lit("")).alias("code"), shown.alias("status"))
    good = F.min(F.when(F.col("status") == "success", F.col("attempt")))
    g = a.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "code", "status"))).alias("all"), F.coalesce(good, F.max("attempt")).alias("last"))
    made = F.filter("all", lambda x: x["attempt"] < F.col("last"))
    end = F.get(F.filter("all", lambda x: x["attempt"] == F.col("last")), F.lit(0))
    return g.select("task_id", F.col("last").alias("attempt"), end["code"].alias("code"), end["status"].alias("status"), made.alias("previous"))
