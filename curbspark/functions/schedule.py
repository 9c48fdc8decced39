"""Local-time tests for recurring no-parking windows.

A window row has `weekday` (a day name or its first letters), `start_time` and
`end_time` as local text, `H:mm`, `HH:mm` or `HH:mm:ss`, and `weeks_of_month` such
as `1,3`, where null or blank means every week.  A window holds its start and not
its end.  One that ends at or before its start runs into the next day; weekday and
week are those of its start.  A window with an unreadable time never holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOCAL_ZONE = "America/Los_Angeles"
# From one fifth weekday to the next is 17 weeks at most, over all 400 years of the calendar's cycle.
# One week more as today's window may have begun.  So this bound never cuts anything off.
WEEKS_AHEAD = 18


def local_time(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of an instant as TIMESTAMP_NTZ, daylight saving included."""
    return F.convert_timezone(None, F.lit(zone), instant)


def weekday_number(weekday: Column) -> Column:
    """1 for Sunday to 7 for Saturday, from the first three letters."""
    position = F.position(F.upper(F.substring(F.trim(weekday), 1, 3)), F.lit("SUNMONTUEWEDTHUFRISAT"))
    return F.when(position % 3 == 1, ((position + 2) / 3).cast("int"))


def seconds_of_day(time: Column) -> Column:
    """Seconds after midnight of a clock text, up to `24:00`; null where it is none."""
    pattern = r"^\s*([0-9]{1,2}):([0-5][0-9])(?::([0-5][0-9]))?(?:\.0*)?\s*$"
    text = time.cast("string")

    def part(k: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, k).try_cast("int"), F.lit(0))

    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(text.rlike(pattern) & (seconds <= 86400), seconds)


def _in_weeks(date: Column, weeks_of_month: Column) -> Column:
    week = F.ceil(F.dayofmonth(date) / 7).cast("string")
    listed = F.split(F.regexp_replace(weeks_of_month, " ", ""), ",")
    return F.coalesce(F.trim(weeks_of_month) == "", F.lit(True)) | F.array_contains(listed, week)


def in_force(local: Column, weekday: Column, start: Column, end: Column, weeks_of_month: Column) -> Column:
    """Whether the window holds at a local wall-clock time."""
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    begins, ends = seconds_of_day(start), seconds_of_day(end)
    overnight = ends <= begins

    def starts_on(date: Column) -> Column:
        return (F.dayofweek(date) == weekday_number(weekday)) & _in_weeks(date, weeks_of_month)

    today, yesterday = F.to_date(local), F.date_sub(F.to_date(local), 1)
    return (starts_on(today) & (clock >= begins) & (overnight | (clock < ends))) | (
        starts_on(yesterday) & overnight & (clock < ends)
    )


# Day names as feeds shorten them, Sunday first.
DAY_NAMES = (("su", "sun"), ("m", "mon"), ("tu", "tue"), ("w", "wed"), ("th", "thu"), ("f", "fri"), ("sa", "sat"))


def on_days(date: Column, days: Column) -> Column:
    """Whether a list such as `Mon,Wed`, `M-F` or `Sat-Mon` names the date's weekday.

    Null, blank and `daily` name every day, and so does a list without any
    readable day: a rule that cannot be read is taken to hold.
    """
    text = F.lower(F.regexp_replace(days, r"\s", ""))
    names = F.create_map(*[F.lit(x) for n, pair in enumerate(DAY_NAMES) for name in pair for x in (name, n)])

    def number(name: Column) -> Column:
        return F.coalesce(F.try_element_at(names, F.substring(name, 1, 3)), F.try_element_at(names, name))

    spans = F.transform(
        F.split(text, "[,;/&]"),
        lambda t: F.struct(
            number(F.split_part(t, F.lit("-"), F.lit(1))).alias("a"),
            number(F.element_at(F.split(t, "-"), -1)).alias("b"),
        ),
    )
    readable = F.filter(spans, lambda s: s.a.isNotNull() & s.b.isNotNull())
    today = F.dayofweek(date) - 1
    named = F.exists(readable, lambda s: F.pmod(today - s.a, F.lit(7)) <= F.pmod(s.b - s.a, F.lit(7)))
    return F.coalesce((text == "") | (text == "daily") | (F.size(readable) == 0) | named, F.lit(True))


def in_hours(local: Column, days: Column, hours: Column) -> Column:
    """Whether a rule with days and hours such as `800-1800` or `8:00 - 18:00` holds at a local time.

    Hours that end at or before their start run into the next day.  Null and
    unreadable hours hold all day.
    """
    pattern = r"^\s*([0-9]{1,2}):?([0-5][0-9])\s*-\s*([0-9]{1,2}):?([0-5][0-9])\s*$"
    clock = F.hour(local) * 60 + F.minute(local)

    def minutes(k: int) -> Column:
        return F.regexp_extract(hours, pattern, k).try_cast("int") * 60 + F.regexp_extract(hours, pattern, k + 1).try_cast("int")

    begins, ends = minutes(1), minutes(3)
    today, yesterday = F.to_date(local), F.date_sub(F.to_date(local), 1)
    overnight = ends <= begins
    timed = (on_days(today, days) & (clock >= begins) & (overnight | (clock < ends))) | (
        on_days(yesterday, days) & overnight & (clock < ends)
    )
    return F.when(F.coalesce(hours.rlike(pattern), F.lit(False)), timed).otherwise(on_days(today, days))


def next_start(local: Column, weekday: Column, start: Column, weeks_of_month: Column) -> Column:
    """First start of the window after a local wall-clock time."""
    today, begins = F.to_date(local), seconds_of_day(start)
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    first = F.date_add(today, F.pmod(weekday_number(weekday) - F.dayofweek(today), F.lit(7)))
    dates = F.transform(F.sequence(F.lit(0), F.lit(WEEKS_AHEAD)), lambda k: F.date_add(first, k * 7))
    later = F.filter(
        dates,
        lambda d: _in_weeks(d, weeks_of_month) & ((d > today) | (begins > clock)),
    )
    day = F.try_element_at(later, F.lit(1))
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=begins.cast("decimal(18,6)"))
