"""Bronze: lower-case names, declared types, nothing else changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from goldseam.schemas import MONEY, TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast the declared columns, add absent ones as typed NULLs, keep extra columns.

    A column that already has its declared type is passed through untouched, so filters on
    stored Bronze still reach the Parquet reader.
    """
    spec = TABLES[table]
    present = {f.name.lower(): f for f in df.schema.fields}
    extra = [f"`{f.name}` AS `{n}`" for n, f in present.items() if n not in spec.columns]
    declared = [
        f"{_typed(present.get(name), kind)} AS {name}" for name, kind in spec.columns.items()
    ]
    return df.selectExpr(*declared, *extra)


def _typed(source: T.StructField | None, kind: str) -> str:
    if source is None:
        return f"CAST(NULL AS {kind})"
    column = f"`{source.name}`"
    if source.dataType.simpleString() == kind:
        return column
    if kind == MONEY:
        column = f"CAST({column} AS double)"
    return f"CAST({column} AS {kind})"


def concat(frames: list[DataFrame]) -> DataFrame:
    """Put the chunks of one table together by column name."""
    return reduce(DataFrame.unionByName, frames)
