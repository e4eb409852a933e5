"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and are at most this many (ids of 8 bytes: some 16 MB).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset: a local one with a local master, as in tests; an error with any other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "wrenloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and reliably checkpointed; their lineage ends here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as compressed Parquet to the shared folder and read again: for what is read several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def heavy_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, most: int = 100_000) -> DataFrame:
    """Inner join of rows with keyed, which has one row a key and in `weight` how many of the rows have it.

    Keys of more than `most` rows are at most the rows divided by that; they are counted and go by broadcast, so that no task gets all
    rows of such a key. The other keys are shuffled. keyed should be cheap to read again.
    """
    many = keyed.where(F.col(weight) > most)
    count = many.count()
    if not count:
        return rows.join(keyed, keys)
    wide = sized(many, count)
    rest = rows.join(wide.select(*keys), keys, "left_anti").join(keyed.where(F.col(weight) <= most), keys)
    return rows.join(wide, keys).unionByName(rest)


def fragments(spark: SparkSession) -> int:
    """How many partitions a hand-made shuffle uses: those of the session's own shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Ask for the removal of shuffle files of plans that nothing refers to any more: Spark removes them when the driver's JVM collects garbage, which may be half an hour later.

    Twice, as the first collection only tells the JVM what Python has dropped.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """In a Python worker: give memory that nothing uses any more back to the system. Workers live on between tasks, and the allocator keeps what was freed."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # not glibc: its allocator decides alone
    _LIBC = None
