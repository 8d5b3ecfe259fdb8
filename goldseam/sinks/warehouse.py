"""Loading Gold into the serving warehouse, with a report of every load."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.versions import publish, read

# Load order, dimensions before facts.
DIMENSIONS = ("dim_date", "dim_customer", "dim_supplier", "dim_part")
FACTS = ("fct_inventory", "fct_sales", "fct_revenue_by_supplier")
LOAD_ORDER = DIMENSIONS + FACTS

# Columns of a staging table: the task that wrote a row, and its attempt.
MARKS = ("load_task", "load_attempt")

REPORT_SCHEMA = "table_name string, row_count bigint, status string"


class LoadFailed(RuntimeError):
    """A load that wrote nothing, or not what it was given."""


class Sink(Protocol):
    def write(self, df: DataFrame, name: str) -> int: ...

    def row_count(self, name: str) -> int: ...


@dataclass(frozen=True)
class ParquetSink:
    spark: SparkSession
    root: str

    def write(self, df: DataFrame, name: str) -> int:
        return publish(df, f"{self.root.rstrip('/')}/{name}")

    def row_count(self, name: str) -> int:
        return read(self.spark, f"{self.root.rstrip('/')}/{name}").count()


@dataclass(frozen=True)
class JdbcSink:
    """Replaces the rows of ``<schema>.<table>`` in one transaction, however often tasks run.

    Rows go to a staging table of the run first, each with the task and the attempt that wrote it.
    A task commits its rows at once or not at all, so an attempt is whole; a task that ran twice,
    after a lost executor or by speculation, is there twice, and the first attempt is taken.  The
    target keeps its grants, since its rows are deleted and inserted, and readers see the old rows
    until the new ones are committed.  A load that is repeated, or stopped anywhere, leaves the
    target as it was or as it should be.

    The schema must exist, and the user may create and drop tables there.  A run that is killed
    leaves its staging table, ``<table>_load_<run>``.  ``connections`` bounds the tasks that write
    at once, and with them the tasks of the last stage; by default nothing is bounded.  ``connect``
    opens a connection for the statements of the driver, by default through the JVM.
    """

    spark: SparkSession
    url: str
    properties: dict[str, str]
    schema: str = "marts"
    connections: int | None = None
    batch_size: int = 10_000
    connect: Callable[[], Any] | None = None

    def write(self, df: DataFrame, name: str) -> int:
        target = f"{self.schema}.{name}"
        stage = f"{target}_load_{uuid.uuid4().hex[:12]}"
        observation = Observation()
        counted = df.observe(observation, F.count(F.lit(1)).alias("rows"))
        try:
            self._jdbc(marked(counted), stage, "error")
            self._jdbc(df.limit(0), target, "append")  # creates it, the first time
            rows = observation.get["rows"]
            self._swap(swap_statements(target, stage, df.columns), rows, name)
        finally:
            self._run([f"DROP TABLE IF EXISTS {stage}"])
        return rows

    def _jdbc(self, df: DataFrame, table: str, mode: str) -> None:
        writer = df.write.option("batchsize", self.batch_size)
        if self.connections:
            writer = writer.option("numPartitions", self.connections)
        writer.jdbc(self.url, table, mode=mode, properties=self.properties)

    def _swap(self, statements: list[str], rows: int, name: str) -> None:
        connection = self._open()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            done = [statement.executeUpdate(sql) for sql in statements]
            if done[-1] != rows:
                raise LoadFailed(f"{name}: wrote {rows} rows, {done[-1]} arrived")
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _run(self, statements: list[str]) -> None:
        connection = self._open()
        try:
            for sql in statements:
                connection.createStatement().executeUpdate(sql)
        finally:
            connection.close()

    def _open(self):
        if self.connect:
            return self.connect()
        jvm = self.spark._jvm
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(
                self.properties["driver"]
            )
        settings = jvm.java.util.Properties()
        for key, value in self.properties.items():
            settings.setProperty(key, value)
        return jvm.java.sql.DriverManager.getConnection(self.url, settings)

    def row_count(self, name: str) -> int:
        counted = self.spark.read.jdbc(
            self.url,
            f"(SELECT COUNT(*) AS n FROM {self.schema}.{name}) q",
            properties=self.properties,
        )
        return int(counted.first()[0])


def marked(df: DataFrame) -> DataFrame:
    """Rows with the task and the attempt that writes them, which only a running task knows."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        numbers = (context.partitionId(), context.taskAttemptId())
        for batch in batches:
            marks = [pa.array([n] * batch.num_rows, pa.int64()) for n in numbers]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *marks], names=[*batch.schema.names, *MARKS]
            )

    schema = T.StructType([*df.schema.fields, *(T.StructField(m, T.LongType()) for m in MARKS)])
    return df.mapInArrow(mark, schema)


def swap_statements(target: str, stage: str, columns: list[str]) -> list[str]:
    """What replaces the rows of a table by those of the first attempt of every task."""
    listed = ", ".join(columns)
    part, attempt = MARKS
    return [
        f"DELETE FROM {target}",
        f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {stage} s WHERE s.{attempt} = "
        f"(SELECT MIN(t.{attempt}) FROM {stage} t WHERE t.{part} = s.{part})",
    ]


def load(df: DataFrame, name: str, sink: Sink) -> int:
    """Load one table; an empty result or a differing read-back count is a failure."""
    written = sink.write(df, name)
    if written == 0:
        raise LoadFailed(f"{name}: no rows to load")
    found = sink.row_count(name)
    if found != written:
        raise LoadFailed(f"{name}: wrote {written} rows, found {found}")
    return written


def load_all(spark: SparkSession, gold: dict[str, DataFrame], sink: Sink) -> DataFrame:
    """Load in order and report; the first failure stops the load and is raised."""
    rows = [(name, load(gold[name], name, sink), "loaded") for name in LOAD_ORDER if name in gold]
    return spark.createDataFrame(rows, REPORT_SCHEMA)
