"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own part of the folder that spark.checkpoint.dir names; a temporary one only in local tests without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="contentloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage_folder(spark: SparkSession) -> str:
    """A new folder name for tables that stages hand on."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the copy in the shared folder survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast: some 10 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that; larger ones are left to a shuffled join. It is counted, so it should be checkpointed."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def give_back() -> None:
    """Returns to the system what the allocators of a Python worker hold without need: Spark keeps the worker beside its heap for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over a task's batches, and give_back() at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints that nothing refers to any more; it learns of them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
