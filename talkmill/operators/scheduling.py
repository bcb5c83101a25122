"""Scheduled tasks: adding, resuming after downtime, firing, fan-out of their results.

tasks: task_id, query, next_time (TIMESTAMP_NTZ), interval (seconds), time_of_day, weekdays array<int>, repetitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions import schedule as sc

TASKS = "task_id bigint, query string, next_time timestamp_ntz, interval bigint, time_of_day string, weekdays array<int>, repetitions bigint"


def _is_calendar():
    return F.col("time_of_day").isNotNull() & F.col("weekdays").isNotNull()


def added(tasks: DataFrame, clock: DataFrame, query: str, interval: int | None = None, time_of_day: str | None = None, weekdays: str | None = None, repetitions: int = -1) -> DataFrame:
    """The tasks with one more, under the next free number. clock: one row (now, last_task_id)."""
    days = sc.weekdays(F.lit(weekdays)) if weekdays else F.lit(None).cast("array<int>")
    top = tasks.agg(F.max("task_id").alias("top"))
    row = clock.crossJoin(top)  # two rows of one
    row = row.select(
        (F.greatest("last_task_id", F.coalesce("top", F.lit(0))) + 1).cast("bigint").alias("task_id"), F.lit(query).alias("query"), "now",
        F.lit(time_of_day).cast("string").alias("time_of_day"), days.alias("weekdays"), F.lit(repetitions).cast("bigint").alias("repetitions"),
    )
    wait = F.lit(interval).cast("bigint") if interval is not None else sc.delay(F.col("now"), sc.next_slot(F.col("now"), F.col("time_of_day"), F.col("weekdays")))
    row = row.withColumn("interval", wait)
    at = F.date_trunc("minute", F.col("now") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("interval").cast("decimal(18,6)"))).cast("timestamp_ntz")
    return tasks.unionByName(row.withColumn("next_time", at).select("task_id", "query", "next_time", "interval", "time_of_day", "weekdays", "repetitions"))


def resumed(tasks: DataFrame, now) -> DataFrame:
    """Tasks after downtime with ``skipped`` runs, their next time, what is left and the wait; those used up are gone.

    Interval tasks move on by whole intervals and lose the repetitions; calendar tasks go to their next slot and
    keep them. An interval of 0 has no next time and gives a null one.
    """
    now = F.lit(now).cast("timestamp_ntz")
    late = now >= F.col("next_time")
    skipped = F.when(_is_calendar(), sc.skipped_slots(F.col("next_time"), now, F.col("time_of_day"), F.col("weekdays")).cast("bigint")).otherwise(
        sc.skipped_intervals(F.col("next_time"), now, F.col("interval"))
    )
    t = tasks.withColumn("skipped", skipped)
    slot = F.when(late, sc.next_slot(now, F.col("time_of_day"), F.col("weekdays"))).otherwise(F.col("next_time"))
    then = F.when(_is_calendar(), slot).otherwise(sc.resumed_interval(F.col("next_time"), F.col("interval"), F.col("skipped")))
    left = F.when(_is_calendar(), F.col("repetitions").cast("bigint")).otherwise(sc.remaining(F.col("repetitions"), F.col("skipped")))
    t = t.withColumns({"next_time": then, "repetitions": left}).filter("repetitions <> 0 OR repetitions IS NULL")
    return t.withColumn("wait", F.greatest(F.lit(0).cast("bigint"), sc.delay(now, F.col("next_time"))))


def fire(tasks: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Tasks due at a moment, and the table with them re-armed first: counted down, moved on, or gone."""
    now = F.lit(now).cast("timestamp_ntz")
    due = F.col("next_time") <= now
    left = sc.decremented(F.col("repetitions"))
    then = F.when(_is_calendar(), sc.next_slot(now, F.col("time_of_day"), F.col("weekdays"))).otherwise(now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("interval").cast("decimal(18,6)")))
    armed = tasks.withColumns({"_left": F.when(due, left).otherwise(F.col("repetitions")), "_then": F.when(due, F.date_trunc("minute", then).cast("timestamp_ntz")).otherwise(F.col("next_time"))})
    armed = armed.filter("_left <> 0").withColumns({"repetitions": F.col("_left").cast("bigint"), "next_time": F.col("_then")}).drop("_left", "_then")
    return tasks.filter(due), armed


def pruned(subscriptions: DataFrame, tasks: DataFrame, chats: DataFrame) -> DataFrame:
    """(task_id, chat_id) pairs of which both still exist; tasks without chats vanish with their pairs."""
    s = subscriptions.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    return s.join(chats.select("chat_id").distinct(), "chat_id", "left_semi").select("task_id", "chat_id")


def fanned_out(pushes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each push message once per subscribed chat, without its query."""
    return pushes.join(subscriptions.select("task_id", "chat_id").distinct(), "task_id").withColumn("query", F.lit(""))
