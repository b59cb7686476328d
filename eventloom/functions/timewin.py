"""Recurrence expansion and wall-clock windows.

Every function takes ``now`` as a column of the instant in question and ``tz``, the
zone whose wall clock counts; nothing reads the clock. Events have start_time,
end_time, is_recurring and recurrence_rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of weekdays (Sunday is 0) and default lengths.
WEEKDAYS = {
    "sun": 0, "sunday": 0, "sundays": 0,
    "mon": 1, "monday": 1, "mondays": 1,
    "tue": 2, "tues": 2, "tuesday": 2, "tuesdays": 2,
    "wed": 3, "weds": 3, "wednesday": 3, "wednesdays": 3,
    "thu": 4, "thur": 4, "thurs": 4, "thursday": 4, "thursdays": 4,
    "fri": 5, "friday": 5, "fridays": 5,
    "sat": 6, "saturday": 6, "saturdays": 6,
}
DAY_NAMES = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
DEFAULT_HOURS = 3
MAX_LIVE_HOURS = 6


def at(text: str) -> Column:
    """An instant given in the session's zone."""
    return F.to_timestamp(F.lit(text))


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL '{int(n * 3600)}' SECOND")


def days(n: Column) -> Column:
    return F.make_dt_interval(n)


def weekday_number(name: Column) -> Column:
    """0 to 6 of a weekday's spelling in lower case, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in WEEKDAYS.items() for x in pair]), name)


def normal_weekday(raw: Column) -> Column:
    """The canonical lower-case weekday of any known spelling, else null."""
    return F.get(F.array(*map(F.lit, DAY_NAMES)), weekday_number(F.lower(F.trim(raw))))


def length_of(start: Column, end: Column) -> Column:
    """Seconds from start to end, three hours without an end, never negative."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)
    return F.when(end.isNull(), F.lit(DEFAULT_HOURS * 3600.0)).otherwise(F.greatest(F.lit(0.0), seconds))


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * 1_000_000).cast("long"))


def effective_start(now: Column, tz: str = "UTC") -> Column:
    """The event's own start, or its next occurrence if it recurs weekly and has begun."""
    start, end = F.col("start_time"), F.col("end_time")
    here, begun = F.from_utc_timestamp(now, tz), F.from_utc_timestamp(start, tz)
    target = weekday_number(F.lower(F.regexp_extract(F.col("recurrence_rule"), r"(?i)every\s+([A-Za-z0-9_]+)", 1)))
    today = F.date_trunc("day", here) + (F.date_trunc("minute", begun) - F.date_trunc("day", begun))
    ahead = F.pmod(target - (F.dayofweek(here) - 1), F.lit(7))
    over = F.unix_micros(_plus_seconds(F.to_utc_timestamp(today, tz), length_of(start, end))) <= F.unix_micros(now)
    next_day = today + days(F.when((ahead == 0) & over, 7).otherwise(ahead))
    recurs = F.coalesce(F.col("is_recurring"), F.lit(False)) & (F.coalesce(F.col("recurrence_rule"), F.lit("")) != "") & (start < now) & target.isNotNull()
    return F.when(recurs, F.to_utc_timestamp(next_day, tz)).otherwise(start)


def with_times(events, now: Column, tz: str = "UTC"):
    """Add eff_start and eff_end."""
    own = events.withColumn("eff_start", effective_start(now, tz))
    return own.withColumn("eff_end", _plus_seconds(F.col("eff_start"), length_of(F.col("start_time"), F.col("end_time"))))


# The predicates below read eff_start and eff_end.


def is_past(now: Column) -> Column:
    return (F.col("eff_start") <= now) & (F.col("eff_end") <= now)


def is_tonight(now: Column, tz: str = "UTC") -> Column:
    """Not over, and starting by three in the morning."""
    cutoff = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, tz)) + F.expr("INTERVAL '27' HOUR"), tz)
    return (F.col("eff_end") > now) & (F.col("eff_start") <= cutoff)


def _day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def is_tomorrow(now: Column, tz: str = "UTC") -> Column:
    return _day(F.col("eff_start"), tz) == F.date_add(_day(now, tz), 1)


def is_same_day(now: Column, tz: str = "UTC") -> Column:
    return _day(F.col("eff_start"), tz) == _day(now, tz)


def is_weekend(now: Column, tz: str = "UTC") -> Column:
    """Saturday or Sunday of this week's end; on a Sunday the day before counts too."""
    today = _day(now, tz)
    saturday = F.date_add(today, F.when(F.dayofweek(today) == 1, -1).otherwise(7 - F.dayofweek(today)))
    own = _day(F.col("eff_start"), tz)
    return (own >= saturday) & (own < F.date_add(saturday, 2))


def is_within_hours(now: Column, n: float) -> Column:
    return F.col("eff_start").between(now, now + hours(n))


def is_live(now: Column) -> Column:
    """Begun at most six hours ago and not over."""
    return (F.col("eff_start") <= now) & (F.col("eff_start") >= now - hours(MAX_LIVE_HOURS)) & (F.col("eff_end") > now)


def is_live_or_soon(now: Column, n: float) -> Column:
    return F.when(F.col("eff_start") > now, F.col("eff_start") <= now + hours(n)).otherwise(is_live(now))


def matches_when(when: str, now: Column, tz: str = "UTC") -> Column:
    """The feed's day filter: all, tonight, tomorrow, weekend or week."""
    found = {
        "all": lambda: F.lit(True),
        "tonight": lambda: is_tonight(now, tz),
        "tomorrow": lambda: is_tomorrow(now, tz),
        "weekend": lambda: is_weekend(now, tz),
        "week": lambda: (F.col("eff_start") >= now) & (F.col("eff_start") < now + hours(7 * 24)),
    }
    return found[when]()


def rounded(x: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(x + F.lit(0.5)).cast("long")


def _minutes_ahead(now: Column) -> Column:
    return (F.unix_micros("eff_start") - F.unix_micros(now)) / F.lit(60_000_000)


def time_label(now: Column) -> Column:
    """Ended, happening, or how far ahead."""
    whole = rounded(_minutes_ahead(now))
    whole_hours = rounded(whole / 60)
    return (
        F.when(F.col("eff_end") <= now, "Ended")
        .when(F.col("eff_start") <= now, "HAPPENING NOW")
        .when(whole <= 60, F.concat(F.lit("Starts in "), whole.cast("string"), F.lit(" min")))
        .when(whole_hours < 24, F.concat(F.lit("In "), whole_hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.lit("In "), rounded(whole_hours / 24).cast("string"), F.lit("d")))
    )


def urgent_label(now: Column, tz: str = "UTC") -> Column:
    minutes = F.greatest(F.lit(0), rounded(_minutes_ahead(now)))
    whole_hours = rounded(minutes / 60)
    return (
        F.when(is_live(now), "Happening now")
        .when(minutes < 60, F.concat(F.lit("Starts in "), minutes.cast("string"), F.lit(" min")))
        .when(whole_hours <= 6, F.concat(F.lit("Starts in "), whole_hours.cast("string"), F.lit("h")))
        .when(is_tonight(now, tz), "Tonight")
        .otherwise("Next up")
    )


def next_occurrence(day_name: Column, time: Column, now: Column, tz: str = "UTC") -> Column:
    """The next such weekday (today included) at ``h:mm AM/PM``; 19:00 without a time, the present time if unreadable."""
    here = F.from_utc_timestamp(now, tz)
    target = weekday_number(F.lower(F.trim(day_name)))
    day = F.date_trunc("day", here) + days(F.pmod(target - (F.dayofweek(here) - 1), F.lit(7)))
    pattern = r"(?i)(\d{1,2}):?(\d{2})?\s*(am|pm)"
    hour, minute, half = (F.regexp_extract(time, pattern, i) for i in (1, 2, 3))
    hour_24 = hour.cast("int") % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)
    read = F.make_dt_interval(F.lit(0), hour_24, F.coalesce(F.nullif(minute, F.lit("")).cast("int"), F.lit(0)))
    of_day = F.when(F.coalesce(time, F.lit("")) == "", F.expr("INTERVAL '19' HOUR")).when(half != "", read).otherwise(here - F.date_trunc("day", here))
    return F.to_utc_timestamp(day + of_day, tz)


def ical_instant(text: Column) -> Column:
    """The three compact forms yyyyMMdd, yyyyMMddTHHmmss and the same with Z, all read as UTC."""
    digits = F.regexp_extract(text, r"^(\d{8})(?:T(\d{6})Z?)?$", 1)
    clock = F.regexp_extract(text, r"^(\d{8})(?:T(\d{6})Z?)?$", 2)
    joined = F.concat(digits, F.when(clock == "", "000000").otherwise(clock))
    return F.when(digits != "", F.try_to_timestamp(joined, F.lit("yyyyMMddHHmmss")))


def after_quiet_hours(ts: Column, start_hour: int, end_hour: int, tz: str = "UTC") -> Column:
    """Moved to the end of the quiet hours [start, end), which may span midnight."""
    here = F.from_utc_timestamp(ts, tz)
    hour, midnight = F.hour(here), F.date_trunc("day", here)
    ends = midnight + F.expr(f"INTERVAL '{end_hour}' HOUR")
    if start_hour <= end_hour:
        moved = F.when((hour >= start_hour) & (hour < end_hour), ends).otherwise(here)
    else:
        moved = F.when(hour >= start_hour, ends + days(F.lit(1))).when(hour < end_hour, ends).otherwise(here)
    return F.to_utc_timestamp(moved, tz)


def reminders(events, now: Column, quiet: tuple[int, int] | None = (22, 8), tz: str = "UTC"):
    """Up to two reminders per event: a day ahead (moved out of the quiet hours) and 9:00 of the day."""
    day_ahead = F.col("eff_start") - hours(24)
    if quiet:
        day_ahead = after_quiet_hours(day_ahead, *quiet, tz)
    morning = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp("eff_start", tz)) + F.expr("INTERVAL '9' HOUR"), tz)
    both = F.array(F.struct(F.lit("day-ahead").alias("kind"), day_ahead.alias("at")), F.struct(F.lit("morning").alias("kind"), F.when(morning > day_ahead, morning).alias("at")))
    listed = events.select("id", "eff_start", F.explode(both).alias("r")).select("id", F.col("r.kind").alias("kind"), F.col("r.at").alias("remind_at"), "eff_start")
    return listed.filter((F.col("remind_at") > now + F.expr("INTERVAL '30' SECOND")) & (F.col("remind_at") < F.col("eff_start"))).drop("eff_start")


def capped_end(start: Column, end: Column, recurring: Column) -> Column:
    """Ends more than twelve hours after a single event's start are set to three hours."""
    return F.when((end - start > F.expr("INTERVAL '12' HOUR")) & ~F.coalesce(recurring, F.lit(False)), start + hours(3)).otherwise(end)


def day_keys(first_day: Column, n: int) -> Column:
    """``yyyyMMdd`` of the day and those after it."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.date_format(F.date_add(first_day, k), "yyyyMMdd"))
