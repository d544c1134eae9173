"""Writers: loads with a quarantine, exports without personal data, run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with ``error_type``, the first check they fail; none is lost.

    A check that is null counts as failed.
    """
    errors = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]) if checks else F.lit(None).cast("string")
    marked = rows.withColumn("error_type", errors)
    return marked.filter("error_type IS NULL").drop("error_type"), marked.filter("error_type IS NOT NULL")


def append(rows: DataFrame, path: str, checks: dict[str, Column], quarantine: str, page: int = 1000) -> tuple[int, int]:
    """Adds the rows that pass every check, at most ``page`` to a file, and the others to the quarantine; returns how many of each.

    Counts are those of the write itself, so nothing is read twice.
    """
    good, bad = split_valid(rows, checks)
    counts = []
    for part, to in ((good, path), (bad, quarantine)):
        seen = Observation()
        part.observe(seen, F.count("*").alias("n")).write.mode("append").option("maxRecordsPerFile", page).parquet(to)
        counts.append(seen.get["n"])
    return counts[0], counts[1]


def csv(rows: DataFrame, path: str) -> None:
    """A report for a spreadsheet: a header, ISO times, lists and structs as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def json_arrays(rows: DataFrame, path: str, size: int = 1000) -> None:
    """Files of one JSON array each, of ``size`` records at most; nulls are written. Rows stay where they are."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                records = batch.column(0).slice(i, size).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([f"[{','.join(records)}]"])], ["value"])

    records = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    records.mapInArrow(joined, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def reload(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, tuple[int, int]]:
    """Replaces tables in the order given (parents first); returns rows expected and found of each."""
    found = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        found[name] = (rows.count(), spark.read.parquet(f"{folder}/{name}").count())
    return found


def export(tables: dict[str, DataFrame], folder: str, private: set[str], null_keys: dict[str, list[str]], left_out: dict[str, list[str]]) -> dict[str, int]:
    """JSON of all tables but the private ones: keys into private tables are nulled, bulky columns left out. Returns row counts."""
    counts = {}
    for name, rows in tables.items():
        if name in private:
            continue
        for key in null_keys.get(name, []):
            rows = rows.withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
        rows = rows.drop(*left_out.get(name, []))
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")
        counts[name] = rows.count()
    return counts


def subset(parents: DataFrame, key: str, n: int, children: dict[str, tuple[DataFrame, str]], preferred: list[Column] | None = None) -> dict[str, DataFrame]:
    """n parents with the child rows that point to them: those of the first preference, then of the next, then fillers, each by key."""
    order = [F.desc(F.coalesce(p, F.lit(False))) for p in preferred or []]
    kept = parents.orderBy(*order, key).limit(n)
    keys = kept.select(F.col(key).alias("_key"))
    return {"": kept} | {name: rows.join(keys, F.col(fk) == F.col("_key"), "left_semi") for name, (rows, fk) in children.items()}


def following(rows: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables cut to what is referred to: each link (from table, its column, to table, its key) in turn keeps the rows of the one that the
    other, as cut so far, points to."""
    cut = dict(rows)
    for source, column, target, key in links:
        wanted = cut[source].select(F.col(column).alias("_key")).distinct()
        cut[target] = cut[target].join(wanted, F.col(key) == F.col("_key"), "left_semi")
    return cut
