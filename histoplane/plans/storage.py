"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors on other machines need a shared folder: set spark.checkpoint.dir")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="histoplane-"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: cuts lineage, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``, 1 to n in the order given: sorted by range, kept, and each partition's first number from the counts before it."""
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = keep(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": low}), "numbered")
    before, at = {}, 1
    for part, n in placed.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        before[part] = at
        at += n
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_part")] if before else F.lit(1)
    return placed.withColumn(out, (first.cast("long") + F.col("_at")).cast("long")).drop("_part", "_at")
