"""Cutting tables into chunks by ranges of their first key column, inside Spark.

Ranges never overlap, so chunks can be read in parallel, in any order and again after a
failure; paging by offset could repeat or lose rows wherever the order is not unique.

Ranges are halves of halves: the range of all keys is halved, and every half again, until it holds
at most ``chunk_size`` rows or a single key.  So chunks are even however the keys are spread.  One
aggregate counts the keys of fine ranges of equal width and is stored; a second one adds them up to
all ranges that hold them.  Only where keys repeat so often that a fine range is still too large are
its keys counted again, one by one.  The driver learns one row per table, what its keys reach from
and to; ranges and chunks stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from goldseam.schemas import Table
from goldseam.scratch import stored

TOP = 62  # the first ranges are the keys below 0 and those from 0 on, as far as 2**62
FINE = 16  # fine ranges for each chunk, if every key has one row

# (level, low, high) -> (number, n, least, most): the rows of every range of 2**level keys.  With
# bounds only of keys between them; without, the NULL keys too, under the number NULL.
Counter = Callable[[int, int | None, int | None], DataFrame]

_CHUNK = "(n <= size OR at = 0) AND ((whole AND at = top) OR n_both > size)"
_TOO_LARGE = "number IS NOT NULL AND n > size AND level > 0"


@dataclass(frozen=True)
class Keyed:
    """A table to be cut, and how its keys are counted."""

    name: str
    chunk_size: int
    count: Counter

    @property
    def level(self) -> int:
        """Of the fine ranges."""
        return max(0, (self.chunk_size // FINE).bit_length() - 1)


def counter(df: DataFrame, column: str) -> Counter:
    """Counts keys of a table that Spark can scan; bounds reach the scan as filters."""
    whole = df.schema[column].dataType.simpleString() == "bigint"
    key = F.col(column) if whole else F.col(column).cast("long")

    def count(level: int, low: int | None, high: int | None) -> DataFrame:
        rows = df if low is None else df.where((key >= low) & (key <= high))
        return rows.groupBy(F.shiftright(key, level).alias("number")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")
        )

    return count


def keyed(frames: Iterable[tuple[DataFrame, Table]], chunk_size: int | None = None) -> list[Keyed]:
    """Tables that Spark can scan."""
    return [
        Keyed(t.name, chunk_size or t.chunk_size, counter(df, t.key[0])) for df, t in frames
    ]


def _named(ranges: DataFrame, table: Keyed, level: int) -> DataFrame:
    return ranges.select(
        F.lit(table.name).alias("table_name"),
        F.lit(table.chunk_size).cast("long").alias("size"),
        F.lit(level).alias("level"),
        "number",
        "n",
        "least",
        "most",
    )


def _halved(ranges: DataFrame) -> DataFrame:
    """All ranges up to ``top`` that hold a given one, with their rows and those of both halves."""
    each = ranges.select("*", F.explode(F.sequence("level", "top")).alias("at")).selectExpr(
        "table_name", "size", "top", "whole", "at", "n",
        "shiftright(shiftright(number, at - level), 1) AS half",
        "shiftright(number, at - level) & 1 AS side",
    )
    sides = [
        F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(f"n{side}")
        for side in (0, 1)
    ]
    halves = each.groupBy("table_name", "size", "top", "whole", "at", "half").agg(*sides)
    return halves.selectExpr(
        "table_name", "size", "top", "whole", "at", "n0 + n1 AS n_both",
        "stack(2, 2 * half, n0, 2 * half + 1, n1) AS (number, n)",
    ).where("n > 0")


def _as_chunks(nodes: DataFrame) -> DataFrame:
    """Ranges as keys from ``low_key`` up to ``high_key``; one without end has no high key.

    A range that needn't be halved at all is one of the first ranges, wherever its keys lie.
    """
    wide = f"IF(whole AND at = top, greatest(at, {TOP}), at)"
    rows = nodes.where(_CHUNK).selectExpr("*", f"{wide} AS wide")
    return rows.selectExpr(
        "table_name",
        "shiftleft(number, wide) AS low_key",
        "CASE WHEN wide < 63 THEN try_add(shiftleft(number, wide), shiftleft(1L, wide)) "
        "WHEN number < 0 THEN 0L END AS high_key",
        "n AS row_count",
    )


def _bits(key: int) -> int:
    """The least level at which a key is in the first range of its sign."""
    return int(key if key >= 0 else ~key).bit_length()


def cut(tables: list[Keyed]) -> DataFrame:
    """Chunks of several tables as (table_name, low_key, high_key, row_count); NULLs have no range."""
    counted = [_named(t.count(t.level, None, None), t, t.level) for t in tables]
    ranges = stored(reduce(DataFrame.unionByName, counted), "key-ranges")
    known = ranges.where("number IS NOT NULL")
    told = (
        known.groupBy("table_name")
        .agg(
            F.min("least").alias("low"),
            F.max("most").alias("high"),
            F.min(F.when(F.expr(_TOO_LARGE), F.col("least"))).alias("close_low"),
            F.max(F.when(F.expr(_TOO_LARGE), F.col("most"))).alias("close_high"),
        )
        .collect()
    )  # a row per table
    nulls = ranges.where("number IS NULL").selectExpr(
        "table_name", "CAST(NULL AS BIGINT) AS low_key", "CAST(NULL AS BIGINT) AS high_key",
        "n AS row_count",
    )
    if not told:
        return nulls
    by_name = {t.name: t for t in tables}
    tops = [(r.table_name, max(_bits(r.low), _bits(r.high))) for r in told]
    top = F.create_map(*(F.lit(x) for pair in tops for x in pair))[F.col("table_name")]
    level = F.greatest(top, F.col("level"))
    wide = known.withColumns({"top": level, "whole": F.lit(True)})
    found = [nulls, _as_chunks(_halved(wide))]
    for row in told:
        if row.close_low is not None:
            table = by_name[row.table_name]
            close = ranges.where(_TOO_LARGE).where(F.col("table_name") == table.name)
            close = close.select(F.col("number").alias("wide"))
            single = table.count(0, row.close_low, row.close_high)
            above = F.shiftright("number", table.level) == F.col("wide")
            keys = _named(single.join(close, above, "left_semi"), table, 0)
            below = keys.withColumns({"top": F.lit(table.level - 1), "whole": F.lit(False)})
            found.append(_as_chunks(_halved(below)))
    return reduce(DataFrame.unionByName, found)


def manifest(tables: list[Keyed]) -> DataFrame:
    """Every chunk of every table: its position there, its range and its rows.

    (table_name, chunk_id, low_key, high_key, row_count), the keys being ``low_key`` up to but not
    including ``high_key``.  The rows whose key is NULL are the last chunk and have no range.
    """
    place = Window.partitionBy("table_name").orderBy(F.col("low_key").asc_nulls_last())
    return cut(tables).select(
        "table_name",
        (F.row_number().over(place) - 1).alias("chunk_id"),
        "low_key",
        "high_key",
        "row_count",
    )


def chunk_manifest(df: DataFrame, table: Table, chunk_size: int | None = None) -> DataFrame:
    """The manifest of one table."""
    return manifest(keyed([(df, table)], chunk_size))


def pieces(chunks: DataFrame, most: int) -> DataFrame:
    """Neighbouring chunks put together to at most ``most`` pieces of a table, of even sizes.

    (table_name, piece, low_key, high_key, row_count, chunk_count); NULL keys stay apart.
    """
    ahead = Window.partitionBy("table_name").orderBy("chunk_id")
    before = F.coalesce(
        F.sum("row_count").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    total = F.sum("row_count").over(Window.partitionBy("table_name"))
    ranges = chunks.where("low_key IS NOT NULL").withColumns({"before": before, "total": total})
    numbered = ranges.withColumn("piece", F.expr(f"CAST({int(most)} * before div total AS int)"))
    nulls = chunks.where("low_key IS NULL").select("*", F.lit(None).cast("int").alias("piece"))
    together = numbered.drop("before", "total").unionByName(nulls)
    # One without end has no high key, and is the last.
    end = F.when(F.count_if(F.col("high_key").isNull()) == 0, F.max("high_key"))
    return together.groupBy("table_name", "piece").agg(
        F.min("low_key").alias("low_key"),
        end.alias("high_key"),
        F.sum("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("chunk_count"),
    )


def cover(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether chunks take every row of their tables once.

    ``counts`` are the rows of tables (table_name, row_count), counted apart.  (table_name,
    chunk_count, largest, row_count, missing, overlaps): the rows of all chunks, the rows of the
    table that they lack, and the ranges that begin before the one ahead ends.
    """
    next_low = F.lead("low_key").over(Window.partitionBy("table_name").orderBy("chunk_id"))
    found = chunks.withColumn("crosses", next_low < F.col("high_key")).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.max("row_count").alias("largest"),
        F.sum("row_count").alias("row_count"),
        F.count_if("crosses").alias("overlaps"),
    )
    there = counts.select("table_name", F.col("row_count").alias("there"))
    return found.join(there, "table_name").select(
        "table_name",
        "chunk_count",
        "largest",
        "row_count",
        (F.col("there") - F.col("row_count")).alias("missing"),
        "overlaps",
    )


def predicates(ranges: Iterable[Row], key: tuple[str, ...], chunk_size: int | None = None) -> list[str]:
    """One predicate for each range; together they take every row once, whatever its key.

    ``ranges`` are rows (low_key, high_key, row_count) in order, those of NULL keys last.  Ranges
    are stretched over the gaps between them and to both ends.  One over ``chunk_size`` (a key, or
    NULL, with very many rows) is cut by the remainder of the second key column, where the key has
    one.
    """
    ranges = list(ranges)
    bounded = [r for r in ranges if r.low_key is not None]
    edges = [None, *(r.low_key for r in bounded[1:]), None]
    conditions = [
        (_between(key[0], edges[i], edges[i + 1]), r.row_count) for i, r in enumerate(bounded)
    ] or [(_between(key[0], None, None), 0)]
    nulls = sum(r.row_count for r in ranges if r.low_key is None)
    conditions.append((f"{key[0]} IS NULL", nulls))
    found = []
    for condition, rows in conditions:
        parts = -(-rows // chunk_size) if chunk_size and len(key) > 1 else 1
        if parts <= 1:
            found.append(condition)
            continue
        remainder = f"MOD(ABS({key[1]}), {parts})"
        found.append(f"({condition}) AND ({remainder} = 0 OR {key[1]} IS NULL)")
        found += [f"({condition}) AND {remainder} = {i}" for i in range(1, parts)]
    return found


def _between(column: str, low: int | None, high: int | None) -> str:
    parts = [f"{column} >= {low}"] if low is not None else []
    parts += [f"{column} < {high}"] if high is not None else []
    return " AND ".join(parts) or f"{column} IS NOT NULL"


def scans(df: DataFrame, column: str, chunks: DataFrame, most: int) -> list[DataFrame]:
    """At most ``most`` + 1 frames that hold every row of a table once, each a range of its keys.

    The ranges are those of the manifest, neighbours put together; the filters reach the scan,
    which skips row groups outside.
    """
    ranges = pieces(chunks, most).orderBy(F.col("piece").asc_nulls_last()).collect()  # bounded
    return [df.filter(F.expr(p)) for p in predicates(ranges, (column,))]
