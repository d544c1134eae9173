"""Payloads of events: JSON objects in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fields(payload: Column) -> Column:
    """The object as a map of names to texts; null if it is none."""
    return F.from_json(payload, "map<string,string>")


def field(payload: Column, *names: str) -> Column:
    """The first of the fields that is there."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def only(payload: Column, names: tuple[str, ...]) -> Column:
    """Of a map, the fields named that are there and not null."""
    return F.map_filter(payload, lambda k, v: k.isin(*names) & v.isNotNull())


def merged(first: Column, second: Column) -> Column:
    """Both maps; where both have a field, the second's value counts."""
    rest = F.map_filter(first, lambda k, v: ~F.map_contains_key(F.coalesce(second, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), F.coalesce(second, F.create_map().cast("map<string,string>")))


def entries(rows: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row for each entry of a map column."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(column).alias(key, value))


def parsed(rows: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is such an object, with ``parsed``, and the others with their error; none is lost."""
    both = rows.withColumn("parsed", F.from_json(column, schema)).withColumn("_ok", F.coalesce(F.col("parsed").isNotNull() & F.try_parse_json(column).isNotNull(), F.lit(False)))
    return both.filter("_ok").drop("_ok"), both.filter("NOT _ok").drop("_ok", "parsed").withColumn("error_type", F.lit("not valid JSON"))


def routed(events: DataFrame, kind: str, catalog: dict[str, str], other: str = "orchestrator") -> DataFrame:
    """Events with the consumer that the catalog names for their kind; failures and alerts go to the orchestrator alone, others unknown too."""
    cases = F.when(F.col(kind).endswith("Failed") | F.col(kind).endswith("Alert"), other)
    for name, consumer in catalog.items():
        cases = cases.when(F.col(kind) == name, consumer)
    return events.withColumn("consumer", cases.otherwise(other))


def in_order(counts: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Counts of the named categories only, those present, with their ``place`` in that order."""
    order = F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int")
    return counts.filter(F.col(column).isin(*names)).withColumn("place", order)
