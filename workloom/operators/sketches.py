"""Distinct counts that are kept up by day: a mergeable sketch for each day, and counts of weeks and of trailing days from the sketches alone.

A day's sketch is made once, when the day is over, and kept as a column of bytes; only the current day is counted from its rows. A week or the last 90
days are then a union of as many sketches, whatever the number of rows behind them. Estimates have a relative standard error of 1.04 / sqrt(2 ** LG)
(0.3 % with 17), and are exact or nearly so for the first few thousand values, which a sketch keeps as they are.

Defined results
    null values don't count; a day of nulls alone has 0. Days without rows have no row of their own but count as nothing in what comes after.
    Repeated rows count once. An empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Base-2 logarithm of the slots of a sketch.
LG = 17


def daily(rows: DataFrame, groups: list[str], day: str, value: str, lg: int = LG) -> DataFrame:
    """The groups and day with ``sketch`` and ``n`` (rows): what is kept."""
    return rows.groupBy(*groups, day).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"), F.count("*").alias("n"))


def trailing(days: DataFrame, groups: list[str], day: str, windows: dict[str, int], lg: int = LG) -> DataFrame:
    """For each day that is kept an estimate of the values of the last so many days, itself included, for each window.

    A day's sketch goes to each day of the window that is kept, and sketches are united there; a group's days are few beside its rows.
    """
    longest = max(windows.values())
    spread = days.select(*groups, F.col(day).alias("_of"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("_ago"))
    moved = spread.select(*groups, F.date_add("_of", F.col("_ago")).alias(day), "sketch", "_ago")
    known = days.select(*groups, day)
    united = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(F.col("_ago") < n, F.col("sketch")))), F.lit(0)).alias(name) for name, n in windows.items()]
    return moved.join(known, [*groups, day]).groupBy(*groups, day).agg(*united)


def rolled_up(days: DataFrame, groups: list[str], period: str) -> DataFrame:
    """Rollup of the groups and a period column: ``estimate`` and ``n`` at every level, from the sketches; grouping_id as ``level``."""
    return days.rollup(*groups, period).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("n").alias("n"), F.grouping_id().alias("level"))


def with_current(days: DataFrame, current: DataFrame, groups: list[str], day: str, value: str, lg: int = LG) -> DataFrame:
    """Kept days with the current one, counted from its rows, in place of what is kept of it."""
    today = daily(current, groups, day, value, lg)
    return days.join(today.select(*groups, day), [*groups, day], "left_anti").unionByName(today)
