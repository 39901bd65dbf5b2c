"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the size, shingle and fingerprint rules: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session (a checkpoint folder set
    on the context counts as well). Only where neither is set, as in local
    tests, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table,
    not the work that made it. It also gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*frames: DataFrame) -> None:
    """Remove staged tables whose rows are no longer read."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
            fs.delete(path, True)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows will go to Python in batches of 1,000 at most, as whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= 1000:
        df.sparkSession.conf.set(key, "1000")
    return df


def release_memory() -> None:
    """Give freed memory back to the system; allocators of C libraries keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; once each is worked off, freed memory goes back.

    A Python worker outlives its task and waits for the next one, so what it
    keeps would be missing in the stages that follow.
    """
    for batch in batches:
        yield batch
        del batch
        release_memory()


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast after counting it; larger ones are joined by shuffle."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column, that name with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other code point stays as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, upper, lower)).otherwise(F.lower(c))


__all__ = ["WORD", "ascii_lower", "broadcast_if_small", "drop_stage", "free_name", "new_path", "release_memory", "released", "shared_dir", "small_enough", "stage", "text_batches"]
