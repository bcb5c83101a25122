"""Queries over recurrences: ``events`` as moments and as scheduled tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import schedule as sc
from talkmill.operators import scheduling as ops
from talkmill.sources.tables import load

from .base import query

NOW = "2024-02-10 09:30:00"

#: Time of day and weekdays of an event, as both engines write them.
_TIME = "lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0')"
_DAYS = "CASE event_id % 4 WHEN 0 THEN [0, 2, 4] WHEN 1 THEN [weekday(ts::DATE)] WHEN 2 THEN [5, 6] ELSE [0, 1, 2, 3, 4, 5, 6] END"
_DUCK_DAYS = _DAYS.replace("weekday(ts::DATE)", "(isodow(ts) - 1)::INT")


def _slots(spark, sf):
    e = load(spark, sf, "events")
    pad = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    one = F.col("event_id") % 4
    lists = F.when(one == 0, F.array(*map(F.lit, (0, 2, 4)))).when(one == 1, F.array(F.weekday("ts"))).when(one == 2, F.array(F.lit(5), F.lit(6))).otherwise(F.array(*map(F.lit, range(7))))
    return e.withColumn("time_of_day", F.concat_ws(":", pad(24), pad(60))).withColumn("weekdays", lists)


def _next(moment: str) -> str:
    """DuckDB: the first slot after the moment."""
    day = f"(date_trunc('day', {moment}) + to_days(i::INT) + to_hours((event_id % 24)::INT) + to_minutes((event_id % 60)::INT))"
    return f"list_min(list_filter(list_transform(range(8), lambda i: {day}), lambda s: s > {moment} AND list_contains(days, (isodow(s) - 1)::INT)))"


_SLOTS = f"s AS (SELECT *, {_DUCK_DAYS} AS days FROM events)"


@query("x22_next_slot", f"WITH {_SLOTS} SELECT event_id, {_next('ts')} AS next_time FROM s")
def next_slot(spark, sf):
    return _slots(spark, sf).select("event_id", sc.next_slot(F.col("ts"), F.col("time_of_day"), F.col("weekdays")).alias("next_time"))


@query("x23_delay", f"WITH {_SLOTS} SELECT event_id, ceil(date_diff('microsecond', ts, {_next('ts')}) / 1e6)::BIGINT AS delay FROM s")
def delay(spark, sf):
    return _slots(spark, sf).select("event_id", sc.delay(F.col("ts"), sc.next_slot(F.col("ts"), F.col("time_of_day"), F.col("weekdays"))).alias("delay"))


def _tasks(spark, sf, calendar: bool):
    """Interval tasks, or calendar tasks whose stored time is a slot of theirs."""
    t = _slots(spark, sf)
    t = t.select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("query"),
        (sc.next_slot(F.col("ts"), F.col("time_of_day"), F.col("weekdays")) if calendar else F.col("ts")).alias("next_time"),
        ((F.col("event_id") % 5 + 1) * 77_777).cast("bigint").alias("interval"),
        *(F.col(c) if calendar else F.lit(None).cast(k).alias(c) for c, k in (("time_of_day", "string"), ("weekdays", "array<int>"))),
        (F.col("event_id") % 40 - 1).cast("bigint").alias("repetitions"),
    )
    return t.filter("repetitions <> 0")


_SKIPPED = f"CASE WHEN TIMESTAMP '{NOW}' >= ts THEN ceil(date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 1e6 / iv)::BIGINT ELSE 0 END"


@query("x24_resumed_intervals", f"""SELECT task_id, skipped, ts + to_seconds(iv * skipped) AS next_time, CASE WHEN r >= 0 THEN greatest(0, r - skipped) ELSE r END AS repetitions,
greatest(0, ceil(date_diff('microsecond', TIMESTAMP '{NOW}', ts + to_seconds(iv * skipped)) / 1e6))::BIGINT AS wait
FROM (SELECT event_id AS task_id, ts, (event_id % 5 + 1) * 77777 AS iv, event_id % 40 - 1 AS r, {_SKIPPED.replace("iv", "((event_id % 5 + 1) * 77777)")} AS skipped FROM events)
WHERE r <> 0 AND (r < 0 OR r > skipped)""")
def resumed_intervals(spark, sf):
    return ops.resumed(_tasks(spark, sf, False), NOW).select("task_id", "skipped", "next_time", "repetitions", "wait")


_ALL_SLOTS = f"""list_filter(list_transform(range(0, date_diff('day', n, TIMESTAMP '{NOW}') + 1), lambda i: date_trunc('day', n) + to_days(i::INT) + to_hours((event_id % 24)::INT) + to_minutes((event_id % 60)::INT)),
lambda s: s >= n AND s <= TIMESTAMP '{NOW}' AND list_contains(days, (isodow(s) - 1)::INT))"""


@query("x24_resumed_calendar", f"""WITH {_SLOTS}, n AS (SELECT *, {_next('ts')} AS n FROM s WHERE event_id % 40 <> 1), k AS (SELECT *, TIMESTAMP '{NOW}' AS now FROM n)
SELECT event_id AS task_id, len({_ALL_SLOTS})::BIGINT AS skipped, CASE WHEN n <= now THEN {_next('now')} ELSE n END AS next_time, event_id % 40 - 1 AS repetitions FROM k""")
def resumed_calendar(spark, sf):
    return ops.resumed(_tasks(spark, sf, True), NOW).select("task_id", "skipped", "next_time", "repetitions")


@query("x25_decremented", "SELECT event_id, CASE WHEN r > 0 THEN r - 1 WHEN r < 0 THEN r END AS left FROM (SELECT event_id, event_id % 7 - 2 AS r FROM events)")
def decremented(spark, sf):
    return load(spark, sf, "events").select("event_id", sc.decremented(F.col("event_id") % 7 - 2).alias("left"))


@query("x26_stored_time", "SELECT event_id, strftime(ts, '%b %d %Y %H:%M') AS stored, date_trunc('minute', ts) AS parsed FROM events")
def stored_time(spark, sf):
    text = sc.stored_time(F.col("ts"))
    return load(spark, sf, "events").select("event_id", text.alias("stored"), sc.parsed_time(text).alias("parsed"))


@query("x21_weekdays", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0,6' WHEN 1 THEN '2' END AS days FROM events")
def weekdays(spark, sf):
    names = F.when(F.col("event_id") % 3 == 0, "Monday, SUN").when(F.col("event_id") % 3 == 1, " wednesday").otherwise("mon,holiday")
    return load(spark, sf, "events").select("event_id", F.array_join(sc.weekdays(names).cast("array<string>"), ",").alias("days"))


@query("t11_due_tasks", f"SELECT event_id AS task_id FROM events WHERE event_id % 40 <> 1 AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def due(spark, sf):
    return ops.fire(_tasks(spark, sf, False), "2024-01-15 00:00:00")[0].select("task_id")


@query("t11_rearmed_tasks", """SELECT task_id, CASE WHEN due THEN date_trunc('minute', TIMESTAMP '2024-01-15 00:00:00' + to_seconds(iv)) ELSE ts END AS next_time, CASE WHEN due AND r > 0 THEN r - 1 ELSE r END AS repetitions
FROM (SELECT event_id AS task_id, ts, ts <= TIMESTAMP '2024-01-15 00:00:00' AS due, (event_id % 5 + 1) * 77777 AS iv, event_id % 40 - 1 AS r FROM events) WHERE r <> 0 AND NOT (due AND r = 1)""")
def rearmed(spark, sf):
    return ops.fire(_tasks(spark, sf, False), "2024-01-15 00:00:00")[1].select("task_id", "next_time", "repetitions")


def _subscriptions(spark, sf):
    return load(spark, sf, "events").select((F.col("event_id") % 400).alias("task_id"), F.col("user_id").alias("chat_id")).distinct()


_SUBS = "sub AS (SELECT DISTINCT event_id % 400 AS task_id, user_id AS chat_id FROM events)"


@query("j2_pruned_subscriptions", f"WITH {_SUBS} SELECT task_id, chat_id FROM sub WHERE task_id IN (SELECT item_id * 7 FROM benchmark) AND chat_id IN (SELECT conv_id FROM conversations)")
def pruned(spark, sf):
    tasks = load(spark, sf, "benchmark").select((F.col("item_id") * 7).alias("task_id"))
    chats = load(spark, sf, "conversations").select(F.col("conv_id").alias("chat_id"))
    return ops.pruned(_subscriptions(spark, sf), tasks, chats)


@query("j12_fanned_out", f"WITH {_SUBS} SELECT item_id AS task_id, chat_id, text AS content, '' AS query FROM benchmark JOIN sub ON task_id = item_id")
def fanned_out(spark, sf):
    pushes = load(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.lit("remind").alias("query"), F.col("text").alias("content"))
    return ops.fanned_out(pushes, _subscriptions(spark, sf)).select("task_id", "chat_id", "content", "query")
