"""Text compared as people do: whatever its case, or its case and accents, by collated string types, in joins, grouping and sorting alike.

A collated column carries the rule with it: equality, grouping, joins and order all follow it, and the values keep their own spelling. Spark joins and
groups them by the collation's key, so this costs no more than a column of such keys would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The rules, by what they overlook.
CASE, CASE_AND_ACCENT, ASCII_CASE = "UNICODE_CI", "UNICODE_CI_AI", "UTF8_LCASE"


def like(text: Column, rule: str = CASE_AND_ACCENT) -> Column:
    """The text under a rule of comparison."""
    return F.collate(text.cast("string"), rule)


def plain(text: Column) -> Column:
    """The text under the comparison of bytes again."""
    return F.collate(text, "UTF8_BINARY")


def spellings(rows: DataFrame, column: str, rule: str = CASE_AND_ACCENT) -> DataFrame:
    """name (the smallest spelling by bytes), spellings (how many there are), n (rows) of what a rule holds to be one name; null is no name."""
    named = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_own"))
    found = named.groupBy(like(F.col("_own"), rule).alias("_rule")).agg(F.min("_own").alias("name"), F.count_distinct("_own").alias("spellings"), F.count("*").alias("n"))
    return found.select("name", "spellings", "n")


def joined(left: DataFrame, right: DataFrame, on: tuple[str, str], rule: str = CASE_AND_ACCENT, how: str = "inner") -> DataFrame:
    """Rows whose names a rule holds to be one."""
    return left.join(right, like(F.col(on[0]), rule) == like(F.col(on[1]), rule), how)


def ordered(rows: DataFrame, column: str, *also: str, rule: str = CASE_AND_ACCENT) -> DataFrame:
    """Rows in the order of names; those that the rule holds to be one by their bytes, then by the other columns."""
    return rows.orderBy(like(F.col(column), rule), column, *also)
