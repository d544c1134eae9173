"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder; Spark alone opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
