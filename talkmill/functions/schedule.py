"""Recurrence arithmetic on wall-clock times (TIMESTAMP_NTZ: no time zone, no daylight-saving shifts).

Weekdays are numbered from Monday = 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first letters of the weekdays, from Monday.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Fixed value: how tasks store a time.
FORMAT = "MMM dd yyyy HH:mm"


def weekdays(names: Column) -> Column:
    """Comma-separated day names as numbers; null if any is no day."""
    days = F.array(*map(F.lit, DAYS))
    found = F.transform(F.split(names, ","), lambda d: (F.array_position(days, F.substring(F.lower(F.trim(d)), 1, 3)) - 1).cast("int"))
    return F.when(~F.exists(found, lambda d: d < 0), found)


def slot(day: Column, time_of_day: Column) -> Column:
    """The day at HH:MM."""
    hour, minute = (F.get(F.split(time_of_day, ":"), F.lit(i)).cast("int") for i in (0, 1))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def next_slot(now: Column, time_of_day: Column, days: Column) -> Column:
    """The first slot after now on one of the weekdays; null without weekdays."""
    ahead = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.date_add(now.cast("date"), i))
    fits = F.filter(ahead, lambda d: F.array_contains(days, F.weekday(d)) & (slot(d, time_of_day) > now))
    return F.array_min(F.transform(fits, lambda d: slot(d, time_of_day)))


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, as a double."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def delay(now: Column, then: Column) -> Column:
    """Whole seconds to wait, rounded up."""
    return F.ceil(seconds_between(now, then)).cast("bigint")


def skipped_intervals(then: Column, now: Column, interval: Column) -> Column:
    """Repetitions that went by since ``then``; null for an interval of 0."""
    late = F.ceil(F.try_divide(seconds_between(then, now), interval)).cast("bigint")
    return F.when(now >= then, late).otherwise(F.lit(0).cast("bigint"))


def resumed_interval(then: Column, interval: Column, skipped: Column) -> Column:
    return then + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (interval * skipped).cast("decimal(18,6)"))


def remaining(repetitions: Column, skipped: Column) -> Column:
    """Repetitions left; a negative number is endless."""
    return F.when(repetitions >= 0, F.greatest(F.lit(0).cast("bigint"), repetitions - skipped)).otherwise(repetitions.cast("bigint"))


def skipped_slots(then: Column, now: Column, time_of_day: Column, days: Column) -> Column:
    """Slots from ``then`` (itself one) to now, closed form of stepping from slot to slot."""
    dates = F.sequence(then.cast("date"), F.greatest(then.cast("date"), now.cast("date")))
    later = F.filter(dates, lambda d: F.array_contains(days, F.weekday(d)) & (slot(d, time_of_day) > then) & (slot(d, time_of_day) <= now))
    return F.when(now >= then, F.size(later) + 1).otherwise(F.lit(0))


def decremented(repetitions: Column) -> Column:
    """After one run: positive counts go down, negative ones stay; 0 is not allowed and gives null."""
    return F.when(repetitions > 0, repetitions - 1).when(repetitions < 0, repetitions)


def stored_time(t: Column) -> Column:
    """As tasks are stored, without seconds."""
    return F.date_format(t, FORMAT)


def parsed_time(s: Column) -> Column:
    return F.to_timestamp_ntz(s, F.lit(FORMAT))


def local_text(t: Column, zone: str, layout: str = "EEEE, yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC moment as text of a time zone."""
    return F.date_format(F.from_utc_timestamp(t, zone), layout)


def time_and_place(t: Column, zone: str, place: Column) -> Column:
    """The sentence that tells a model the time, and the place where one is given."""
    now = F.concat(F.lit("The current date and time is "), local_text(t, zone, "MMMM dd yyyy, HH:mm"))
    return F.concat(now, F.coalesce(F.concat(F.lit(". You are located at "), F.nullif(place, F.lit(""))), F.lit("")), F.lit("."))
