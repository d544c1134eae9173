"""Tables that a computation writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, removed when the driver ends; only where that is unset, on one machine, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}/workloom-{os.getuid()}"
    if not _folders:
        atexit.register(_clean)
    path = f"{shared.rstrip('/')}/workloom-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def _clean() -> None:
    for path, spark in _folders.items():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once and read again: what follows doesn't compute them anew, nor depends on the executors that did."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
