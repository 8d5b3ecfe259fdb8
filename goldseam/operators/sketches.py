"""Profiles by sketches that add up: one small row per part of a table and column.

A part (a day, a file, a chunk) is sketched when it arrives, and never read for the profile again:
distinct values by HyperLogLog, quantiles by KLL.  The profile of a table merges the rows of its
parts, so it costs as much as there are parts and columns, however many rows they had.  Counts of
whole-number keys are exact by bitmaps, which add up as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Registers of a distinct-value sketch, as a power of two: a standard error of 0.8 %.
REGISTERS = 14
#: Items that a level of a quantile sketch keeps: ranks are right within 0.5 %.
LEVEL_ITEMS = 800
#: What a distinct count may be off, in shares of it (four standard errors), and a rank of all rows.
DISTINCT_ERROR, RANK_ERROR = 0.033, 0.005

PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)

SKETCHES = (
    "table_name string, part string, column_name string, row_count long, null_count long, "
    "distinct_sketch binary, quantile_sketch binary"
)


def sketched(df: DataFrame, table: str, part: str = "") -> DataFrame:
    """One row per column: its rows, its NULLs and its sketches, from one scan.

    Text has no quantiles; a column without values has a sketch of nothing.  Sketches that nobody
    reads are not made: the rows are picked from arrays, one for each kind of sketch.
    """
    aggregates, names, nulls, distinct, quantiles = ["count(1) AS row_count"], [], [], [], []
    for i, field in enumerate(df.schema.fields):
        column = f"`{field.name}`"
        aggregates.append(f"count({column}) AS n{i}")
        aggregates.append(f"hll_sketch_agg({_countable(field)}, {REGISTERS}) AS d{i}")
        number = number_of(field)
        if number:
            aggregates.append(f"kll_sketch_agg_double({number}, {LEVEL_ITEMS}) AS q{i}")
        names.append(f"'{field.name}'")
        nulls.append(f"row_count - n{i}")
        distinct.append(f"d{i}")
        quantiles.append(f"q{i}" if number else "CAST(NULL AS BINARY)")
    picked = {
        "column_name": names, "null_count": nulls, "distinct_sketch": distinct, "quantile_sketch": quantiles
    }
    numbered = df.selectExpr(*aggregates).selectExpr(
        "*", f"explode(sequence(0, {len(names) - 1})) AS column_no"
    )
    return numbered.selectExpr(
        f"'{table}' AS table_name",
        f"'{part}' AS part",
        *(f"array({', '.join(cells)})[column_no] AS {name}" for name, cells in picked.items()),
        "row_count",
    ).select(*(f.name for f in T.StructType.fromDDL(SKETCHES)))


def _countable(field: T.StructField) -> str:
    """A value as something that sketches take, equal values alike."""
    column = f"`{field.name}`"
    if isinstance(field.dataType, T.DateType):
        return f"CAST(unix_date({column}) AS BIGINT)"
    if isinstance(field.dataType, T.IntegralType):
        return f"CAST({column} AS BIGINT)"
    zero = " + 0.0D" if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else ""
    return f"CAST({column}{zero} AS STRING)"


def number_of(field: T.StructField) -> str | None:
    """A number or a date as a double; None for what has no quantiles."""
    if isinstance(field.dataType, T.DateType):
        return f"CAST(unix_date(`{field.name}`) AS DOUBLE)"
    return f"CAST(`{field.name}` AS DOUBLE)" if isinstance(field.dataType, T.NumericType) else None


def merged(sketches: DataFrame) -> DataFrame:
    """The sketches of all parts of a table as those of the table."""
    return sketches.groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.expr("hll_union_agg(distinct_sketch)").alias("distinct_sketch"),
        F.expr("kll_merge_agg_double(quantile_sketch)").alias("quantile_sketch"),
    )


def distinct_estimates(whole: DataFrame) -> DataFrame:
    """(table_name, column_name, row_count, null_count, distinct_values), NULL being a value."""
    found = F.expr("hll_sketch_estimate(distinct_sketch)") + (F.col("null_count") > 0).cast("int")
    return whole.select(
        "table_name", "column_name", "row_count", "null_count", found.alias("distinct_values")
    )


def quantiles(whole: DataFrame, probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """(table_name, column_name, probability, quantile) of numbers; dates as days since 1970."""
    some = "kll_sketch_get_n_double(quantile_sketch) > 0"
    rows = ", ".join(
        f"{p}D, IF({some}, kll_sketch_get_quantile_double(quantile_sketch, {p}D), NULL)"
        for p in probabilities
    )
    return whole.selectExpr(
        "table_name", "column_name", f"stack({len(probabilities)}, {rows}) AS (probability, quantile)"
    ).where("quantile IS NOT NULL")


def key_bitmaps(df: DataFrame, column: str) -> DataFrame:
    """Bitmaps of a whole-number column: (bucket, bits), 32,768 values in a bucket; NULLs are left out."""
    key = F.col(column).cast("long")
    return (
        df.where(key.isNotNull())
        .groupBy(F.bitmap_bucket_number(key).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
    )


def distinct_keys(bitmaps: DataFrame) -> DataFrame:
    """How many values bitmaps of any parts of a table hold together, exactly."""
    whole = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_values"))


class SketchStore:
    """Sketches of the parts of tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, df: DataFrame, table: str, part: str) -> None:
        """Sketch a part; one that is there already gives way, all others aren't read."""
        rows = sketched(df, table, part).coalesce(1)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "table_name", "part"
        ).parquet(self.path)

    def read(self) -> DataFrame:
        names = [f.name for f in T.StructType.fromDDL(SKETCHES)]
        return self.spark.read.schema(SKETCHES).parquet(self.path).select(*names)

    def profile(self) -> DataFrame:
        return merged(self.read())
