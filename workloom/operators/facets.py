"""Faceted search: predicates made from a request, pages with a total count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(*predicates: Column | None) -> Column:
    """Those that are given, all true; none given is true."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def any_of(*predicates: Column | None) -> Column:
    """Any of those that are given; none given is true, as an empty facet restricts nothing."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a | b, given) if given else F.lit(True)


def one_of(column: Column, values: list | None) -> Column | None:
    """In the list without its blank items; no predicate if nothing is left."""
    kept = [v for v in values or [] if not isinstance(v, str) or v.strip()]
    return column.isin(kept) if kept else None


def between(column: Column, least=None, most=None) -> Column | None:
    sides = [column >= least if least is not None else None, column <= most if most is not None else None]
    return all_of(*sides) if any(s is not None for s in sides) else None


def page(found: DataFrame, order: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page of the ordered rows, each with the number of all rows. The order must end in a key."""
    total = found.agg(F.count("*").alias("total_count"))  # one row
    return found.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def related(parents: DataFrame, children: DataFrame, key: str, child_key: str, predicate: Column) -> DataFrame:
    """Parents with some child for which the predicate holds."""
    return parents.join(children.filter(predicate), F.col(key) == F.col(child_key), "left_semi")


def active(until: Column, as_of: str) -> Column:
    """Not yet expired; a posting without an end is active."""
    return until.isNull() | (until > F.lit(as_of).cast("timestamp"))


def upcoming(day: Column, as_of: str) -> Column:
    """Later than 48 hours ago: events of the last two days are still listed."""
    return day > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 48 HOURS")


def past(day: Column, as_of: str) -> Column:
    return day < F.lit(as_of).cast("timestamp")
