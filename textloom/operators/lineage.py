"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set")
        at = tempfile.mkdtemp(prefix="textloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow functions that run inside get so many rows a batch: each task holds a batch in the JVM and twice in Python, up to 64 MB of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes a core below which a table is dealt out over all cores before work that takes long a row.
SMALL = 16_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores if it is small: its file may be one row group, which is one task. A table that fills the cores anyway stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


#: Rows and bytes that an Arrow function takes up at once.
SLICE_ROWS, SLICE_BYTES = 64, 1_000_000


def sliced(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """make over few rows at a time: Spark's batch has up to 10,000, and what is made of all of them would be in memory at once, for each core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(SLICE_ROWS, len(batch) * SLICE_BYTES // max(1, batch.nbytes)))
            for at in range(0, len(batch), rows):
                yield make(batch.slice(at, rows))

    return run
