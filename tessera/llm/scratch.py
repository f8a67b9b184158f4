"""Where operators keep intermediate tables, and how they size a broadcast.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
a folder of our own is made only where that setting is missing and the master is local (tests).
"""

from __future__ import annotations

import ctypes
import gc
import posixpath
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []

#: Rows in one Arrow batch handed to Python, unless the session sets its own.
BATCH_ROWS = 1000
#: Largest table that is ever broadcast; beyond it operators shuffle instead.
BROADCAST_BYTES = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-scratch-"))
        base = _own[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return posixpath.join(scratch_dir(spark), "tessera", f"{label}-{uuid.uuid4().hex}")


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder of the shared store, so that readers find it even if no task writes to it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs one read instead of a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete an intermediate folder that no later step reads."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {posixpath.dirname(f) for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def python_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, unless the user chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker have freed."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def fits(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, measured exactly, is small enough to broadcast."""
    size = F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).cast("long")
    return (df.agg(size).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def field(row: Column, name: str) -> Column:
    return row.getField(name)


def with_column(df: DataFrame, name: str, value: Column) -> list[Column]:
    """The columns of struct ``row`` with one replaced, in their order."""
    return [(value if c == name else F.col("row").getField(c)).alias(c) for c in df.schema["row"].dataType.names]
