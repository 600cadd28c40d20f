"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors on other machines need a shared folder: set spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="histoplane-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are over go once the driver's JVM has collected what names them; a large step asks for that."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions of an explicit shuffle of about ``size`` bytes: the session's number, more where one would hold over ``each`` bytes, unless the size is an unknown one."""
    return max(shuffle_partitions(spark), -(-int(size) // each) if size < 1 << 55 else 1)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, without a job; exabytes where it has none."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def trim_memory() -> None:
    """Gives what a worker has freed back to the system: workers are used again, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
