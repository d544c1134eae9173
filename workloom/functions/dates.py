"""Date expressions with the semantics of the report SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def us_week(day: Column) -> Column:
    """Week of the year as US calendars count it: weeks begin on Sunday and January 1 is always in week 1."""
    first = F.dayofweek(F.trunc(day, "year"))
    return (F.floor((F.dayofyear(day) + first - 2) / 7) + 1).cast("int")


def month_start(day: Column) -> Column:
    """Midnight of the first day of the month."""
    return F.date_trunc("month", day)


def days_away(day: Column, as_of: Column) -> Column:
    """Whole days from one date to another."""
    return F.datediff(F.to_date(day), F.to_date(as_of))


def duration(seconds: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, else minutes and seconds."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long"), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 60).cast("long"), F.lit("m "), (whole % 60).cast("long"), F.lit("s")))
    )


def wall_time(a: Column) -> Column:
    """An ISO text as the time it names, whatever zone it gives; null for any other text."""
    bare = F.regexp_replace(a, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(is_iso(a), F.try_to_timestamp(F.regexp_replace(bare, "T", " ")))


def is_iso(a: Column) -> Column:
    return a.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
