"""Parquet datasets and catalog tables.

Rows are counted while they are written, not by a second run of the plan, and the files are
laid out by the plan's own partitions instead of being forced through one task.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from goldseam.sources.files import SNAPSHOT, index_snapshot, list_files


def with_audit(df: DataFrame, run_at: datetime) -> DataFrame:
    """Add the moment of the run, the same for every row and table of it."""
    return df.withColumn("dbt_updated_at", F.lit(run_at).cast("timestamp"))


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    max_records_per_file: int = 0,
) -> int:
    """Replace a dataset and return the rows written.

    The rows go to a hidden directory beside it, which takes the dataset's place when it is
    complete.  A failed write leaves the last good dataset as it was.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    run = uuid.uuid4().hex
    draft, old = f"{folder}/_{name}-{run}", f"{folder}/_{name}-{run}-old"
    files = _FileSystem(df.sparkSession, path)
    observation = Observation()
    try:
        _writer(_counted(df, observation), partition_by, max_records_per_file).parquet(draft)
        if files.exists(path):
            files.rename(path, old)
        files.rename(draft, path)
    except BaseException:
        if not files.exists(path) and files.exists(old):
            files.rename(old, path)
        files.delete(draft)
        raise
    files.delete(old)
    return observation.get["rows"]


class _FileSystem:
    """The file system of a path, as Spark's own writers use it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def rename(self, source: str, target: str) -> None:
        if not self._files.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def write_table(
    df: DataFrame, name: str, path: str | None = None, partition_by: tuple[str, ...] = ()
) -> int:
    """Replace a catalog table (Parquet, snappy) and return the rows written.

    With a path the files are replaced there as ``write_parquet`` does it, and the table points at
    them; without one the catalog keeps them.
    """
    if path:
        rows = write_parquet(df, path, partition_by)
        register_table(df.sparkSession, name, path, partition_by)
        return rows
    observation = Observation()
    writer = _writer(_counted(df, observation), partition_by, 0).format("parquet")
    writer.saveAsTable(name)
    return observation.get["rows"]


def register_table(
    spark: SparkSession, name: str, path: str, partition_by: tuple[str, ...] = ()
) -> None:
    """Point a catalog table at a dataset; its files are not touched."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rpartition('.')[0]}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path, "parquet")
    if partition_by:
        spark.catalog.recoverPartitions(name)


def write_batches(df: DataFrame, path: str, chunk_size: int) -> DataFrame:
    """Replace a dataset by files of at most ``chunk_size`` rows and list them.

    Nothing of a larger earlier version stays behind.
    """
    write_parquet(df, path, max_records_per_file=chunk_size)
    return list_files(df.sparkSession, path)


def write_snapshot(df: DataFrame, root: str, table: str, snapshot: str | None = None) -> str:
    """Write a snapshot beside the earlier ones, index it and return its name; a rerun replaces it."""
    snapshot = snapshot or datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
    rows = write_parquet(df, f"{root.rstrip('/')}/{table}/{SNAPSHOT}={snapshot}")
    index_snapshot(df.sparkSession, root, table, snapshot, rows)
    return snapshot


def write_all_snapshots(
    frames: dict[str, DataFrame], root: str, snapshot: str | None = None
) -> dict[str, str]:
    """One snapshot of several tables under one name."""
    snapshot = snapshot or datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
    return {table: write_snapshot(df, root, table, snapshot) for table, df in frames.items()}


def _counted(df: DataFrame, observation: Observation) -> DataFrame:
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def _writer(
    df: DataFrame, partition_by: tuple[str, ...], max_records_per_file: int
) -> DataFrameWriter:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    return writer
