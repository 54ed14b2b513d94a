"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes of the scanned files for one partition of a table that is spread.
SPREAD_BYTES = 8 * 1024 * 1024
# More than this is no estimate: rows that come from no file, say.
UNKNOWN_BYTES = 1 << 50


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session (`spark.checkpoint.dir`).

    Only a local master may do without the setting; its folder goes when the driver ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="tagspark-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` now, once, and read it from reliable storage afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as parquet into the shared folder and return the written table."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.staged_path = path
    return stored


def stage_buckets(
    df: DataFrame, name: str, key: str, buckets: int, partition_by: str | None = None
) -> DataFrame:
    """Write `df` into buckets of `key`, one file each, so that grouping and joining the written
    table by `key` moves no row. `partition_by` names a column of few values, stored apart."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, F.col(key)).write.format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    stored = spark.table(table)
    stored.staged_path, stored.staged_table = path, table
    return stored


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(stored: DataFrame) -> None:
    """Delete a table of `stage` or `stage_buckets` that nothing reads any more."""
    spark = stored.sparkSession
    if getattr(stored, "staged_table", None):
        spark.sql(f"drop table if exists {stored.staged_table}")
    if getattr(stored, "staged_path", None):
        delete_path(spark, stored.staged_path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by `key`: rows for every core, and little for one task.

    A few files with one row group each would otherwise keep most cores idle, and whole splits of
    texts make more grams than a task's memory holds. What groups by `key` afterwards moves nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN_BYTES:
        return df.repartition(F.col(key))
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)), F.col(key))
