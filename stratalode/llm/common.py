"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Where the setting is absent on one machine (as in tests) a temporary folder is set; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratalode-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared checkpoint folder, forget the lineage.

    A checkpoint keeps the size that the optimizer guessed for its plan, and a join's guess is the product
    of its sides', so in a loop of joins the guess would grow into a number of megabytes on the driver.
    A guess beyond all measure is dropped with the plan.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    if input_bytes(done) < 1 << 60:
        return done
    bare = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(bare, spark)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of the files below; any file system that Spark reads."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(df: DataFrame, bytes_each: int = 24 << 20) -> int:
    """Partitions for work on whole texts: the session's number, more where the files are larger."""
    set_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(set_, min(1_000_000, size // bytes_each)) if size < 1 << 60 else set_


def buckets(df: DataFrame, n: int, bytes_each: int = 16 << 20) -> int:
    """Bits of hash ranges by the size of the input, so that what a task sends to each range stays worth a row."""
    size = input_bytes(df)
    return max(3, min(24, (size // bytes_each).bit_length())) if size < 1 << 60 else (2 * n - 1).bit_length()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, by the file system that Spark itself uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that is not among `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only where the counted rows stay under `limit`; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def sliced(batches, rows: int = 1000):
    """Arrow batches in pieces, so that the Python objects made of one stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, beside its executor's heap."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
