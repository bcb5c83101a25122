import random
from datetime import datetime, timedelta
from itertools import count

from pyspark.sql import functions as F

from talkmill.functions import schedule as sc
from talkmill.operators import scheduling as ops
from talkmill.operators.registry import tools


def next_slot(now, hh, mm, days):
    at = now.replace(hour=hh, minute=mm, second=0, microsecond=0)
    return next(c for c in (at + timedelta(days=i) for i in range(9)) if c > now and c.weekday() in days)


def random_tasks(rng, n, now):
    rows = []
    for i in range(n):
        then = (now + timedelta(minutes=rng.randrange(-40_000, 3_000))).replace(second=0)
        if i % 2:
            rows.append((i, "q", then, rng.choice([1, 59, 60, 3600, 86400, 100_000]), None, None, rng.choice([-1, 1, 3, 50, 5000])))
        else:
            days = sorted(rng.sample(range(7), rng.randrange(1, 8)))
            rows.append((i, "q", next_slot(then, then.hour, then.minute, days), -1, f"{then.hour:02}:{then.minute:02}", days, -1))
    return rows


def run_times(task):
    """All times at which a task would run, the stored one first: every so many seconds, or day by day on its weekdays."""
    _, _, first, every, clock, days, _ = task
    if clock is None:
        return (first + timedelta(seconds=every * n) for n in count())
    each_day = (first + timedelta(days=n) for n in count())  # slots keep the first one's time of day
    return (t for t in each_day if t.weekday() in days)


def expected(task, now):
    """What is left of a task: the runs that passed, the next one, repetitions, and whole seconds to wait."""
    passed, budget = 0, task[6]
    for at in run_times(task):
        # a slot that is just due counts as passed, an interval's run does not
        if at > now or (at == now and task[4] is None):
            break
        passed += 1
        if task[4] is None and budget > 0:
            budget -= 1
    if budget == 0:
        return None
    wait = at - now
    return (task[0], passed, at, budget, wait.days * 86_400 + wait.seconds + (wait.microseconds > 0))


def test_resume_equals_stepping(spark):
    rng = random.Random(3)
    now = datetime(2024, 2, 29, 13, 7, 31, 250_000)
    rows = random_tasks(rng, 300, now) + [(900, "q", now, 60, None, None, 2), (901, "q", datetime(2024, 2, 29, 13, 7), -1, "13:07", [3], -1)]
    t = spark.createDataFrame(rows, ops.TASKS)
    got = {tuple(r) for r in ops.resumed(t, now).select("task_id", "skipped", "next_time", "repetitions", "wait").collect()}
    assert got == {x for x in (expected(r, now) for r in rows) if x}


def test_zero_interval_gives_no_time(spark):
    t = spark.createDataFrame([(1, "q", datetime(2024, 1, 1), 0, None, None, -1)], ops.TASKS)
    assert ops.resumed(t, datetime(2024, 1, 2)).first().next_time is None


def test_next_slots(spark):
    rng = random.Random(5)
    rows = [(datetime(2024, 3, 31) + timedelta(seconds=rng.randrange(10**6)), f"{rng.randrange(24):02}:{rng.randrange(60):02}", rng.sample(range(7), rng.randrange(1, 8))) for _ in range(200)]
    rows.append((datetime(2024, 1, 1, 9, 0), "09:00", [0]))
    df = spark.createDataFrame(rows, "now timestamp_ntz, t string, d array<int>")
    for r in df.select("*", sc.next_slot(F.col("now"), F.col("t"), F.col("d")).alias("x")).collect():
        assert r.x == next_slot(r.now, *map(int, r.t.split(":")), r.d)
    assert df.select(sc.next_slot(F.col("now"), F.col("t"), F.array().cast("array<int>"))).first()[0] is None


def test_weekday_names(spark):
    df = spark.createDataFrame([("Monday, tue ,SUNDAY",), ("mon,xyz",), ("",)], "d string")
    assert [r[0] for r in df.select(sc.weekdays(F.col("d"))).collect()] == [[0, 1, 6], None, None]


def test_fire_rearms_first(spark):
    now = datetime(2024, 1, 1, 12, 0)
    rows = [(1, "q", now, 3600, None, None, 1), (2, "q", now, 3600, None, None, 2), (3, "q", now + timedelta(1), 60, None, None, 1), (4, "q", now, -1, "12:00", [0], -1)]
    due, armed = ops.fire(spark.createDataFrame(rows, ops.TASKS), now)
    assert {r.task_id for r in due.collect()} == {1, 2, 4}
    got = {r.task_id: (r.next_time, r.repetitions) for r in armed.collect()}
    assert got == {2: (datetime(2024, 1, 1, 13), 1), 3: (now + timedelta(1), 1), 4: (datetime(2024, 1, 8, 12), -1)}


def test_subscriptions(spark):
    s = spark.createDataFrame([(1, "a"), (1, "gone"), (2, "a"), (3, "gone")], "task_id long, chat_id string")
    tasks, chats = spark.createDataFrame([(1,), (3,)], "task_id long"), spark.createDataFrame([("a",)], "chat_id string")
    assert [tuple(r) for r in ops.pruned(s, tasks, chats).collect()] == [(1, "a")]
    out = ops.fanned_out(spark.createDataFrame([(1, "ask", "done")], "task_id long, query string, content string"), s).collect()
    assert sorted((r.chat_id, r.query, r.content) for r in out) == [("a", "", "done"), ("gone", "", "done")]


def test_tools_by_name(spark):
    tasks = spark.createDataFrame([(4, "q", datetime(2024, 1, 1), 60, None, None, 1)], ops.TASKS)
    clock = spark.createDataFrame([(datetime(2024, 1, 3, 10, 0, 30), 9)], "now timestamp_ntz, last_task_id long")
    state = {"tasks": tasks, "clock": clock}
    new = tools.call("Scheduling--ScheduleCalendarTask", state, query="go", time_of_day="10:00", weekdays="wed").filter("task_id = 10").first()
    assert new.next_time == datetime(2024, 1, 10, 10) and new.weekdays == [2] and new.repetitions == -1
    new = tools.call("Scheduling--ScheduleIntervalTask", state, query="go", delay_seconds=90, repetitions=3).filter("task_id = 10").first()
    assert (new.next_time, new.interval, new.repetitions) == (datetime(2024, 1, 3, 10, 2), 90, 3)
    assert tools.call("Scheduling--CancelScheduleTask", state, task_id=4).count() == 0
    for bad, args in (("Scheduling--ScheduleIntervalTask", {"query": "x"}), ("Scheduling--CancelScheduleTask", {"task_id": 1, "x": 2})):
        try:
            tools.call(bad, state, **args)
        except TypeError:
            continue
        raise AssertionError(bad)
    c = {f"{r.provider}--{r.tool}": r.required for r in tools.catalogue(spark).collect()}
    assert c["Scheduling--ScheduleIntervalTask"] == ["query", "delay_seconds", "repetitions"]
