"""Profiles of a table, each from a single scan.

Expressions over all columns are written as SQL text: a wide table needs hundreds of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that reads as a number.  Tested first, because a failing cast costs an exception.
NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def row_counts(df: DataFrame, table: str) -> DataFrame:
    return df.selectExpr("count(1) AS row_count").selectExpr(
        f"'{table}' AS table_name", "row_count"
    )


def partition_counts(df: DataFrame, table: str) -> DataFrame:
    """Rows held by each partition of the frame as it is read."""
    return (
        df.groupBy(F.spark_partition_id().alias("partition_id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .selectExpr(f"'{table}' AS table_name", "partition_id", "row_count")
    )


def table_info(df: DataFrame, table: str) -> DataFrame:
    """Row count with one row per column, its position and its type."""
    columns = [
        (str(i), f"'{f.name}'", f"'{f.dataType.simpleString()}'")
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return row_counts(df, table).selectExpr(
        "*", _stack(columns, "position", "column_name", "column_type")
    )


def null_counts(df: DataFrame, table: str) -> DataFrame:
    columns = df.columns
    totals = df.selectExpr(
        "count(1) AS row_count", *(f"count(`{c}`) AS n{i}" for i, c in enumerate(columns))
    )
    nulls = [(f"'{c}'", f"row_count - n{i}") for i, c in enumerate(columns)]
    return totals.selectExpr(
        f"'{table}' AS table_name", "row_count", _stack(nulls, "column_name", "null_count")
    )


def cardinality(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """Distinct values per column, NULL counting as a value; 0 in an empty table.

    The exact form turns the columns into (column, value) pairs and removes duplicates on the
    map side before the shuffle, so only distinct values travel: whole numbers and dates as
    numbers, decimals as decimals, the rest as text.  The approximate form keeps one sketch per
    column and shuffles no values at all.
    """
    columns = df.columns
    if approximate:
        sketches = df.selectExpr(
            *(
                f"approx_count_distinct(`{c}`) + coalesce(max(int(`{c}` IS NULL)), 0) AS d{i}"
                for i, c in enumerate(columns)
            )
        )
        counted = [(f"'{c}'", f"d{i}") for i, c in enumerate(columns)]
        return sketches.selectExpr(
            f"'{table}' AS table_name", _stack(counted, "column_name", "distinct_values")
        )
    scale = max((f.dataType.scale for f in df.schema.fields if _is_decimal(f)), default=0)
    cells = [(str(i), *_typed_cell(f, scale)) for i, f in enumerate(df.schema.fields)]
    per_column = (
        df.selectExpr(_stack(cells, "column_no", "whole", "amount", "words"))
        .distinct()
        .groupBy("column_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row even without input; its map has an entry per column that has rows.
    found = per_column.agg(
        F.map_from_entries(F.collect_list(F.struct("column_no", "n"))).alias("found")
    )
    counted = [(f"'{c}'", f"coalesce(found[{i}], 0L)") for i, c in enumerate(columns)]
    return found.selectExpr(
        f"'{table}' AS table_name", _stack(counted, "column_name", "distinct_values")
    )


def _is_decimal(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.DecimalType)


def _typed_cell(field: T.StructField, scale: int) -> tuple[str, str, str]:
    """A value in the slot of its kind: whole number, decimal of the given scale, or text."""
    column, kind = f"`{field.name}`", field.dataType
    whole, amount, words = "CAST(NULL AS BIGINT)", f"CAST(NULL AS DECIMAL(38,{scale}))", "NULL"
    if isinstance(kind, T.DateType):
        whole = f"CAST(unix_date({column}) AS BIGINT)"
    elif isinstance(kind, T.IntegralType):
        whole = f"CAST({column} AS BIGINT)"
    elif _is_decimal(field) and kind.precision - kind.scale + scale <= 38:
        amount = f"CAST({column} AS DECIMAL(38,{scale}))"
    else:
        words = _as_text(field)
    return whole, amount, f"CAST({words} AS STRING)"


def _as_text(field: T.StructField) -> str:
    fraction = isinstance(field.dataType, (T.FloatType, T.DoubleType))
    zero = " + 0.0D" if fraction else ""  # one zero, not two
    return f"`{field.name}`{zero}"


def numeric_stats(df: DataFrame, table: str) -> DataFrame:
    """Count, mean, standard deviation, smallest and largest value of numbers and text.

    Text has a mean only as far as it reads as numbers.  Dates are left out.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    aggregates = []
    for i, f in enumerate(fields):
        exact = column = f"`{f.name}`"
        number = f"CAST({column} AS DOUBLE)"
        if isinstance(f.dataType, T.StringType):
            exact = number = f"IF({column} RLIKE '{NUMBER}', TRY_CAST({column} AS DOUBLE), NULL)"
        aggregates += [
            f"count({column}) AS count{i}",
            f"try_divide(CAST(sum({exact}) AS DOUBLE), count({exact})) AS mean{i}",
            f"stddev_samp({number}) AS stddev{i}",
            f"min({column}) AS min{i}",
            f"max({column}) AS max{i}",
        ]
    stats = [
        (
            f"'{f.name}'",
            f"count{i}",
            f"mean{i}",
            f"stddev{i}",
            f"CAST(min{i} AS STRING)",
            f"CAST(max{i} AS STRING)",
        )
        for i, f in enumerate(fields)
    ]
    names = ("column_name", "value_count", "mean", "stddev", "min_value", "max_value")
    return df.selectExpr(*aggregates).selectExpr(f"'{table}' AS table_name", _stack(stats, *names))


def sample_rows(df: DataFrame, table: str, key: tuple[str, ...], n: int = 5) -> DataFrame:
    """The first ``n`` rows by key, one output row per cell.

    The remaining columns break ties, so the choice does not depend on partitioning.
    """
    columns = df.columns
    first = df.orderBy(*key, *(c for c in columns if c not in key)).limit(n)
    cells = [(f"'{c}'", f"CAST(`{c}` AS STRING)") for c in columns]
    row_key = " || '|' || ".join(f"coalesce(CAST(`{c}` AS STRING), '')" for c in key)
    return first.selectExpr(
        f"'{table}' AS table_name",
        f"{row_key} AS row_key",
        _stack(cells, "column_name", "value"),
    )


def hash_sample(
    df: DataFrame, key: tuple[str, ...], n: int, strata: tuple[str, ...] = ()
) -> DataFrame:
    """``n`` rows of every stratum: those whose keys have the smallest hashes.

    The hash makes the choice even over the table, and the same whatever the partitioning; rows
    with one key are told apart by their other columns.  Every task keeps its own ``n`` of a
    stratum before the shuffle, and samples of parts of a table add up: the sample of their union
    is the sample of the table.
    """
    said = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    rest = [F.col(c) for c in df.columns if c not in key]
    strata_columns = [F.col(c) for c in strata] or [F.lit(0)]
    place = Window.partitionBy(*strata_columns).orderBy("_hash", *key, *rest)
    hashed = df.withColumn("_hash", F.md5(said.cast("binary")))
    return (
        hashed.withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") <= n)
        .drop("_place", "_hash")
    )


def sample_cells(sample: DataFrame, table: str, key: tuple[str, ...], stratum: str) -> DataFrame:
    """A sample as one row per cell: (table_name, stratum, row_key, column_name, value)."""
    cells = [(f"'{c}'", f"CAST(`{c}` AS STRING)") for c in sample.columns]
    row_key = " || '|' || ".join(f"coalesce(CAST(`{c}` AS STRING), '')" for c in key)
    return sample.selectExpr(
        f"'{table}' AS table_name",
        f"CAST(`{stratum}` AS STRING) AS stratum",
        f"{row_key} AS row_key",
        _stack(cells, "column_name", "value"),
    )


def over_tables(profiles: list[DataFrame]) -> DataFrame:
    """The same profile of several tables as one frame."""
    return reduce(DataFrame.unionByName, profiles)


def _stack(rows: list[tuple[str, ...]], *names: str) -> str:
    """SQL that turns each tuple of expressions into a row."""
    cells = ", ".join(", ".join(row) for row in rows)
    return f"stack({len(rows)}, {cells}) AS ({', '.join(names)})"
