"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of texts in an Arrow batch where the session doesn't say; with Spark's 10,000 a batch of long texts takes much of a worker.
BATCH_ROWS = 2000


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plyforge-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage, which on large tables is too late."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """A folder of Parquet tables for one run of an operator.

    Each name is written once, so a lost executor costs a re-read and not the lineage before it. What is
    shuffled for a table goes when it is written.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        # results are read lazily, so tables that are still there go when the driver ends
        path, system = self._path()
        system.mkdirs(path)  # only what exists is registered
        system.deleteOnExit(path)

    def _path(self, *names: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with passing_shuffles(self.spark):
            df.write.parquet(path, compression="zstd")
        self.saved.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)
        self.saved.remove(name)


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches, after whose tasks the worker gives unused memory back: workers live on into later stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows.sparkSession.conf.get(key, None) is None:
        rows.sparkSession.conf.set(key, str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return rows.mapInArrow(trimmed, schema)


def distinct_names(passed: tuple[str, ...], *made: str) -> None:
    """A passed column of a result's own name would be ambiguous."""
    if twice := sorted({c for c in (*passed, *made) if (*passed, *made).count(c) > 1}):
        raise ValueError(f"passed columns and results share names: {', '.join(twice)}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
