"""Part-supplier stock for the given tables, which have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.operators import bronze
from goldseam.schemas import MONEY
from goldseam.scratch import stored
from goldseam.sources.files import ParquetSource

PATTERN = "{table}.parquet"


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Raw tables of a directory, ``partsupp`` being derived from the lines if it is not there.

    Derived stock is written once for each reader, as the raw table that it stands for.
    """
    source = ParquetSource(spark, sf_dir, PATTERN)

    def read(table: str) -> DataFrame:
        try:
            return source.read(table)
        except AnalysisException as missing:
            if table != "partsupp" or missing.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = bronze.conform(source.read("lineitem"), "lineitem")
            if table not in made:
                made[table] = stored(stock_from_lines(lines), table)
            return made[table]

    made: dict[str, DataFrame] = {}
    return read


def stock_from_lines(lineitem: DataFrame) -> DataFrame:
    """Part-supplier stock made up from the lines.

    One row per (part, supplier) pair sold, quantity and cost being fixed functions of the
    two keys.  The duplicate elimination combines on the map side, so a hot pair costs one
    row per task.
    """
    p, s = F.col("ps_partkey"), F.col("ps_suppkey")
    band = (31 * p + 17 * s) % 10
    quantity = (
        F.when(band == 0, (p + s) % 101)
        .when(band < 4, 101 + (7 * p + s) % 900)
        .otherwise(1001 + (13 * p + 29 * s) % 8999)
    )
    cents = 100 + (53 * p + 97 * s) % 99900
    pairs = lineitem.select(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")
    ).distinct()
    return pairs.select(
        p,
        s,
        quantity.cast(MONEY).alias("ps_availqty"),
        (cents.cast("decimal(17,2)") / 100).cast(MONEY).alias("ps_supplycost"),
        F.lit(None).cast("string").alias("ps_comment"),
    )
