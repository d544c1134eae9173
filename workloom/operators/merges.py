"""Tables that are changed bucket by bucket: a change rewrites the buckets of its keys and leaves the files of all others as they are.

A table is a folder with a subfolder for each bucket, the bucket of a row being a hash of its key. A merge counts which buckets the change has keys of,
reads those alone (by literals, so that the scan opens no other), makes their rows anew and puts them in place of the old by dynamic partition
overwrite: Spark writes them aside and swaps folders when all are there, so a run that is broken off changes nothing. Two changes of one
table at a time are the caller's to keep apart.

Defined results
    Rows of which a key column is null lie in the bucket of their hash like others, but match nothing and are left as they are; in the change
    they are added by an upsert. An empty change rewrites nothing. Of change rows with one key the first in the order counts, as in ``upserts``.
    A bucket whose rows are all deleted becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.operators import upserts
from workloom.sources.scratch import written

BUCKET = "_bucket"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _put(rows: DataFrame, path: str, mode: str) -> None:
    by_bucket = rows.repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET)
    by_bucket.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


class Table:
    """A bucketed table at a path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, keys, schema, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int) -> Table:
        """Keys keep their types: the hash of a key depends on them."""
        _put(_bucketed(rows, keys, buckets), path, "errorifexists")
        return cls(rows.sparkSession, path, keys, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), buckets)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).drop(BUCKET)

    def touched(self, change: DataFrame) -> list[int]:
        """The buckets that hold keys of a change: numbers, as many as the table has buckets at most."""
        return sorted(r[0] for r in _bucketed(self._typed(change), self.keys, self.buckets).select(BUCKET).distinct().collect())

    def _typed(self, change: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.read().schema}
        return change.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in change.columns])

    def _replace(self, change: DataFrame, make) -> list[int]:
        change = written(self._typed(change))
        buckets = self.touched(change)
        if buckets:
            # made and written before the folders that they come from are swapped
            after = _bucketed(make(self.read(buckets), change), self.keys, self.buckets)
            kept = written(after)
            _put(kept, self.path, "overwrite")
            left = {r[0] for r in kept.select(BUCKET).distinct().collect()}
            for bucket in set(buckets) - left:
                self._empty(bucket)
        return buckets

    def _empty(self, bucket: int) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def upsert(self, change: DataFrame, order: list[Column] | None = None) -> list[int]:
        """Rows of the change replace those of their key or are added; returns the buckets that were rewritten."""
        return self._replace(change, lambda rows, new: upserts.upsert(rows, new, self.keys, order))

    def insert_absent(self, change: DataFrame) -> list[int]:
        """Rows of the change are added where the table lacks their key."""
        return self._replace(change, lambda rows, new: upserts.insert_absent(rows, new, self.keys))

    def update(self, change: DataFrame, column: str) -> list[int]:
        """One column is set where the change has another value for the key."""
        return self._replace(change, lambda rows, new: upserts.update(rows, new, self.keys, column).drop("changed"))

    def delete(self, keys_of: DataFrame) -> list[int]:
        return self._replace(keys_of, lambda rows, gone: upserts.delete(rows, gone.select(*self.keys), self.keys))
