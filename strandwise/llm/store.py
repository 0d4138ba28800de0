"""The folder that the driver and all executors share, and tables staged in it."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that may be broadcast (about 16 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Keys that hold more than 1/HOT_SHARE of all rows are hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Ways in which the rows of a hot key are split.
SALTS = 32
#: Rows and bytes in an Arrow batch: bound what a Python worker holds, also where texts are long.
BATCH_ROWS, BATCH_BYTES = 4000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one is set, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/strandwise/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the process
        pass


def staged(df: DataFrame, name: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Writes a DataFrame once in the shared folder and reads it from there: lineage ends, lost executors cost nothing.

    Tables noted in ``scratch`` can go together, by ``release``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.append(found)
    return found


def release(scratch: list[DataFrame]) -> None:
    """Deletes staged tables that nothing still to be computed needs, and lets Spark drop the shuffles behind them."""
    if scratch:
        spark = scratch[0].sparkSession
        for table in scratch:
            discard(table)
        scratch.clear()
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver's JVM finds their plans unused


def discard(df: DataFrame) -> None:
    """Deletes the table that a staged DataFrame reads, when nothing that is still to be computed needs it."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/strandwise/".split("://")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: What tasks of one kind leave in their worker for the next ones.
KEPT: dict = {}


def forget() -> None:
    """Drops ``KEPT`` of this process; a function of the module, as tasks would take a copy of the table along."""
    KEPT.clear()


def trimmed(task, keeps: bool = False):
    """A function of Arrow batches that gives back what its process holds but does not use, when a task ends: workers live on.

    Unless it ``keeps`` them, what tasks of other kinds left in the worker goes too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case: underscores come first where it is."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def arrow_batches(spark: SparkSession) -> None:
    """Sets the session's bounds of Arrow batches: a batch ends at either."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows stay within the bound; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def by_hot_key(left: DataFrame, classes: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Inner join of many rows with one row per key, where a few keys may hold most rows of ``left``.

    ``classes[size]`` tells how many rows of ``left`` a key has. Keys with over 1/HOT_SHARE of all rows are at
    most HOT_SHARE, so their list may be broadcast; their rows are dealt over SALTS values of ``spread``.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = classes.where(F.col(size) * HOT_SHARE > F.lit(total)).select(F.col(key).alias("__hot"))
    if not hot.limit(1).count():
        return left.join(classes, key)
    salts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    flagged = classes.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    right = flagged.withColumn("__salt", F.explode(salts)).drop("__hot")
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    many = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    return many.join(right, [key, "__salt"]).drop("__salt")
