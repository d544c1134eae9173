"""What the operators of this subpackage share: input tables, word patterns and scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that takes texts to Python; a longer text goes whole.
BATCH_BYTES = 4 << 20

_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns that most operators read; nothing else of the table reaches them."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def words(text: Column) -> Column:
    """All words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python, as JVM and worker each hold one whole, the JVM outside its heap.

    It is a setting of the session, read when a plan runs, so it stays set; results don't depend on it. A lower one is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def returning_memory(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A stage for mapInArrow that gives free memory back to the system when its task ends, as workers live on for other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset, as in tests, a local one is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    mine = f"file://{tempfile.gettempdir()}/workloom-{os.getuid()}"
    spark.conf.set("spark.checkpoint.dir", mine)
    return mine


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    root = f"{shared_folder(spark)}/workloom-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_clean)
    _folders[root] = spark
    return root


def _clean() -> None:
    for root in list(_folders):
        drop(_folders[root], root)


def drop(spark: SparkSession, root: str) -> None:
    """Removes a scratch table; a session that has ended already leaves it."""
    _folders.pop(root, None)
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def materialize(frame: DataFrame) -> DataFrame:
    """Writes a frame into the shared folder and reads it again: what follows doesn't depend on the executors that computed it."""
    spark = frame.sparkSession
    root = scratch(spark)
    frame.write.parquet(root)
    again = spark.read.schema(frame.schema).parquet(root)
    again._workloom_scratch = root
    return again


def release(frame: DataFrame) -> None:
    """Removes the table behind a materialized frame once nothing reads it any more."""
    drop(frame.sparkSession, frame._workloom_scratch)
