"""Datasets that are published in one step, and a log of what was published.

A dataset is a folder of versions, each a complete Parquet dataset, beside a log.  A version is
published by one more record in the log, a file that comes into being whole; nothing is moved,
replaced or emptied for it.  Readers follow the latest record, so they see the old version or the
new one at any moment, and a reader that has begun keeps its files, because the last versions stay.

    <path>/versions/<version>/...     the rows
    <path>/_log/...                   a record for each published version

A version may be bucketed: its files are dealt and sorted by a key, and readers get it as a table of
the catalog that knows so, whose joins and aggregates on the key need no shuffle.

Only Spark's own readers and writers are used to write, publish and read; files of versions that
are out of use are deleted through the file system.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

KEEP = 2  # versions that stay: the current one, and the one that readers may still be in

RECORD = (
    "number long, name string, row_count long, files long, bytes long, published timestamp, "
    "bucket_key string, buckets int, made_from string"
)

BUCKETED = "goldseam_buckets"  # the database of tables over bucketed versions
UNEVEN = 5  # times the mean rows that the largest bucket may have
FEW_ROWS = 100_000  # in tables of fewer, uneven buckets do no harm


@dataclass(frozen=True)
class Buckets:
    """How the rows of a version are dealt: by the hash of a key, sorted by it in every bucket."""

    key: str
    count: int


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log, RECORD; FileNotFoundError if nothing was ever published there."""
    try:
        return spark.read.schema(RECORD).json(f"{path.rstrip('/')}/_log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"nothing was published at {path}") from missing


def latest(spark: SparkSession, path: str) -> Row:
    """The record that was added last; of two with one number the greater name."""
    last = log_records(spark, path).orderBy(F.desc("number"), F.desc("name")).first()
    if last is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return last


def record(
    spark: SparkSession,
    path: str,
    name: str,
    rows: int,
    files: int | None = None,
    size: int | None = None,
    buckets: Buckets | None = None,
    made_from: str | None = None,
) -> Row:
    """Add a record behind all others, as one file."""
    try:
        number = latest(spark, path).number + 1
    except FileNotFoundError:
        number = 1
    dealt = (buckets.key, buckets.count) if buckets else (None, None)
    values = (number, name, rows, files, size, datetime.now(UTC).replace(tzinfo=None), *dealt, made_from)
    added = spark.createDataFrame([values], RECORD).coalesce(1)
    added.write.mode("append").json(f"{path.rstrip('/')}/_log")
    return added.first()


def version_path(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}"


def write_version(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), buckets: Buckets | None = None
) -> tuple[str, int]:
    """Write a version that nobody reads yet; its name and its rows.  A failed write leaves nothing."""
    spark, observation = df.sparkSession, Observation()
    version = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    folder = version_path(path, version)
    counted = df.observe(observation, F.count(F.lit(1)).alias("rows"))
    if buckets:  # dealt as the buckets are, so that every bucket is one file
        counted = counted.repartition(buckets.count, buckets.key)
    writer = counted.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        if buckets:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {BUCKETED}")
            writer = writer.bucketBy(buckets.count, buckets.key).sortBy(buckets.key)
            writer.format("parquet").option("path", folder).saveAsTable(_table_of(version))
        else:
            writer.parquet(folder)
    except BaseException:
        if buckets:
            spark.sql(f"DROP TABLE IF EXISTS {_table_of(version)}")
        _delete(spark, folder)
        raise
    return version, observation.get["rows"]


def publish(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    keep: int = KEEP,
    buckets: Buckets | None = None,
    made_from: str | None = None,
) -> int:
    """Replace what readers of a dataset see, in one step, and return the rows written.

    A write that fails, or is interrupted anywhere, leaves the dataset as it was or as it should
    be.  What a killed one left behind is no version; ``drafts`` tells it, ``drop_drafts`` deletes it.

    Buckets of a hot key can be split neither here nor by a reader.  If the largest one would have
    more than ``UNEVEN`` times the mean rows, which a count by bucket tells before, the version is
    written without them, and joins shuffle and split it.

    ``made_from`` tells the inputs of the version, for ``rows_made_from``.
    """
    spark = df.sparkSession
    buckets = buckets if buckets and even(df, buckets) else None
    version, rows = write_version(df, path, partition_by, buckets)
    record(spark, path, version, rows, buckets=buckets, made_from=made_from)
    clean(spark, path, keep)
    return rows


def even(df: DataFrame, buckets: Buckets) -> bool:
    """Whether no bucket would have far more rows than others; reads the key alone."""
    number = F.pmod(F.hash(buckets.key), F.lit(buckets.count))
    sizes = df.groupBy(number.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return (found.most or 0) * buckets.count <= UNEVEN * max(found.rows or 0, FEW_ROWS)


def _table_of(version: str) -> str:
    return f"{BUCKETED}.v_{version.replace('-', '_').lower()}"


def _bucketed(spark: SparkSession, path: str, last: Row) -> DataFrame:
    """A bucketed version as a table, made known to a catalog that doesn't have it yet."""
    name, folder = _table_of(last.name), version_path(path, last.name)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {BUCKETED}")
        columns = spark.read.parquet(folder).schema
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet "
            f"CLUSTERED BY (`{last.bucket_key}`) SORTED BY (`{last.bucket_key}`) "
            f"INTO {last.buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(name)


def rows_made_from(spark: SparkSession, path: str, inputs: str | None) -> int | None:
    """The rows of the current version if it was made from just these inputs, else None."""
    try:
        last = latest(spark, path)
    except FileNotFoundError:
        return None
    return last.row_count if inputs is not None and last.made_from == inputs else None


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the version that is current now."""
    return version_path(path, latest(spark, path).name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current version; the frame stays with it when another one is published."""
    last = latest(spark, path)
    if last.buckets:
        return _bucketed(spark, path, last)
    return spark.read.parquet(version_path(path, last.name))


def point_view(spark: SparkSession, name: str, path: str) -> None:
    """Let a view of the catalog show the current version, by one change of the catalog.

    A table of this name, from before views, gives way to it once.
    """
    database, _, short = name.rpartition(".")
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    folder = current_path(spark, path).replace("`", "``")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{folder}`")


def clean(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Delete the files of published versions but for the last ``keep``; their names.

    Versions that are not in the log may still be written by somebody and stay; ``drafts`` has
    them.  Records stay too, as the history of the dataset.
    """
    order = [F.desc("number"), F.desc("name")]
    old = [r.name for r in log_records(spark, path).orderBy(*order).collect()][max(1, keep) :]
    here = _names_below(spark, f"{path.rstrip('/')}/versions") if old else set()
    gone = [name for name in old if name in here]
    for name in gone:
        _delete(spark, version_path(path, name))
        spark.sql(f"DROP TABLE IF EXISTS {_table_of(name)}")
    return gone


def drafts(spark: SparkSession, path: str) -> list[str]:
    """Versions that are not published: writes under way, or interrupted ones."""
    try:
        known = {r.name for r in log_records(spark, path).select("name").collect()}
    except FileNotFoundError:
        known = set()
    return sorted(_names_below(spark, f"{path.rstrip('/')}/versions") - known)


def drop_drafts(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete what interrupted writes left; the caller knows that nobody writes them any more."""
    for name in set(names) & set(drafts(spark, path)):
        _delete(spark, version_path(path, name))


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _names_below(spark: SparkSession, path: str) -> set[str]:
    hadoop, files = _files(spark, path)
    if not files.exists(hadoop):
        return set()
    return {status.getPath().getName() for status in files.listStatus(hadoop)}


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, files = _files(spark, path)
    files.delete(hadoop, True)


class PublishedSource:
    """Published datasets below one root, by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.path(name))

    def input_bytes(self) -> int:
        """Size of the current versions below the root, as their plans tell it."""
        names = _names_below(self.spark, self.root)
        return sum(_size(self.spark, current) for current in self._current(names))

    def _current(self, names: set[str]):
        for name in sorted(names):
            try:
                yield current_path(self.spark, self.path(name))
            except FileNotFoundError:
                continue


def _size(spark: SparkSession, path: str) -> int:
    hadoop, files = _files(spark, path)
    return files.getContentSummary(hadoop).getLength()
