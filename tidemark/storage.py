"""Working tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_folders[context.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes the frame once and reads it back: lineage ends here and lost executors cost nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffles of each job in the block go from disk when the job ends; else they stay until the driver's memory is
    collected, so that jobs which follow each other fill the disks. For jobs that end in a table or in the driver."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def placed(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """``df`` as a table with ``place``, its number in the order. One count per sorted partition goes through one task."""
    sorted_ = as_table(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), label)
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    shifts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return sorted_.join(F.broadcast(shifts), "_part").withColumn("place", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")
