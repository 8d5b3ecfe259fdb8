"""Parquet datasets, their files and their snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.versions import latest, log_records, record

SNAPSHOT = "snapshot"


class ParquetSource:
    """Tables below one root; ``pattern`` says where a table's files are."""

    def __init__(self, spark: SparkSession, root: str, pattern: str = "{table}"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.pattern = pattern

    def path(self, table: str) -> str:
        return f"{self.root}/{self.pattern.format(table=table)}"

    def read(self, table: str) -> DataFrame:
        """All files of a table as one frame, under the names and types they were written with."""
        return self.spark.read.parquet(self.path(table))

    def input_bytes(self) -> int:
        """Size of everything below the root, from the file listing alone."""
        total = list_files(self.spark, self.root).agg(F.sum("length").alias("bytes")).first()
        return total.bytes or 0


def read_parquet(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None
) -> DataFrame:
    """Any number of files or directories of one table, in one scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def scan_as_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Query a path as if it were a table."""
    return spark.sql(f"SELECT {', '.join(columns) or '*'} FROM parquet.`{path}`")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the session's catalog."""
    return spark.table(name)


def list_files(spark: SparkSession, prefix: str, suffix: str = "") -> DataFrame:
    """Files below a prefix as (path, length, modified), or those whose names end with a suffix.

    No file is opened.  Hidden ones, whose names begin with "_" or ".", are left out.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(prefix)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def list_snapshots(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Snapshots of a table as (snapshot, files, bytes, row_count, modified), from their index.

    The index has a record for every write of a snapshot; no data file is listed.
    """
    records = log_records(spark, f"{root.rstrip('/')}/{table}")
    fields = ("files", "bytes", "row_count", F.col("published").alias("modified"))
    last = F.max(F.struct("number", *fields)).alias("last")
    return records.groupBy(F.col("name").alias(SNAPSHOT)).agg(last).select(
        SNAPSHOT, "last.files", "last.bytes", "last.row_count", "last.modified"
    )


def index_snapshot(spark: SparkSession, root: str, table: str, snapshot: str, rows: int) -> None:
    """Add a snapshot, whose files are complete, to the index of its table."""
    folder = f"{root.rstrip('/')}/{table}"
    held = list_files(spark, f"{folder}/{SNAPSHOT}={snapshot}").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    found = held.first()
    record(spark, folder, snapshot, rows, found.files, found.bytes)


def index_snapshots(spark: SparkSession, root: str, table: str) -> list[str]:
    """Index the snapshots that were written before there was an index, the oldest first."""
    folder = f"{root.rstrip('/')}/{table}"
    try:
        known = {r.name for r in log_records(spark, folder).select("name").distinct().collect()}
    except FileNotFoundError:
        known = set()
    name = F.regexp_extract("path", f"/{SNAPSHOT}=([^/]+)/", 1)
    times = (
        list_files(spark, folder, ".parquet")
        .groupBy(name.alias(SNAPSHOT))
        .agg(F.max("modified").alias("modified"))
        .orderBy("modified", SNAPSHOT)
    )
    new = [r[SNAPSHOT] for r in times.collect() if r[SNAPSHOT] and r[SNAPSHOT] not in known]
    for snapshot in new:
        rows = spark.read.parquet(f"{folder}/{SNAPSHOT}={snapshot}").count()
        index_snapshot(spark, root, table, snapshot, rows)
    return new


def read_snapshot(
    spark: SparkSession, root: str, table: str, snapshot: str | None = None
) -> DataFrame:
    """A named snapshot, or the one written last, as the index tells."""
    folder = f"{root.rstrip('/')}/{table}"
    if snapshot is None:
        snapshot = latest(spark, folder).name
    return spark.read.parquet(f"{folder}/{SNAPSHOT}={snapshot}")
