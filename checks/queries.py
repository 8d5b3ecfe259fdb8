"""Every operator as a query over a directory of raw tables.

Decimals leave as double here, because the SQL engine on the other side of the check has
other decimal result types; inside the package they stay exact.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import stock
from goldseam.operators import bronze, dashboards, profile, silver, sketches
from goldseam.plans import pipeline, quality
from goldseam.plans.warehouse import MARTS, Warehouse, bronze_of
from goldseam.schemas import TABLES
from goldseam.scratch import stored
from goldseam.sources import chunks

Query = Callable[[SparkSession, str], DataFrame]

# Rows of a chunk in the manifest: few enough for several chunks of every large table.
CHUNK_ROWS = 1_000

# Strata that samples represent, and rows of each.
STRATA = {
    "customer": "c_mktsegment",
    "orders": "o_orderstatus",
    "lineitem": "l_returnflag",
}
STRATUM_ROWS = 4

# Parts that every table is sketched in.
SKETCH_PARTS = 3

# Scans that a table's chunks are read in.
CHUNK_SCANS = 8

# A standard deviation is a floating-point sum, whose last digits depend on its order.
NINE_DIGITS = "IF(stddev IS NOT NULL, CAST(format_string('%.8e', stddev) AS DOUBLE), NULL)"


_OPEN: WeakKeyDictionary[SparkSession, dict[str, Warehouse]] = WeakKeyDictionary()


def open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse over a directory of raw tables.

    A session opens a directory once, as a user does: files are listed and schemas read then, and
    no rows are kept.
    """
    opened = _OPEN.setdefault(spark, {})
    if sf_dir not in opened:
        opened[sf_dir] = Warehouse(bronze=bronze_of(stock.reader(spark, sf_dir)))
    return opened[sf_dir]


def as_doubles(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        *(
            f"CAST({f.name} AS DOUBLE) AS {f.name}"
            if isinstance(f.dataType, T.DecimalType)
            else f.name
            for f in df.schema.fields
        )
    )


def registered() -> dict[str, Query]:
    named: dict[str, Callable[[Warehouse], DataFrame]] = {
        "fct_revenue_by_supplier": lambda w: w.mart("fct_revenue_by_supplier"),
        "src_bronze_scan": lambda w: _per_table(w, profile.row_counts),
        "src_chunk_manifest": lambda w: chunks.manifest(_keyed(w)),
        "src_chunk_cover": _chunk_cover,
        "src_ingest_report": _ingest_report,
        "src_table_info": lambda w: _per_table(w, profile.table_info),
        "silver_row_delta": lambda w: _per_table(w, silver.row_delta),
        "profile_row_counts": lambda w: profile.over_tables(
            [profile.row_counts(w.silver(t), t) for t in TABLES]
        ),
        "profile_cardinality": lambda w: _per_table(w, profile.cardinality),
        "profile_numeric_stats": lambda w: _per_table(w, profile.numeric_stats).withColumn(
            "stddev", F.expr(NINE_DIGITS)
        ),
        "profile_distinct_sketch": _distinct_sketch,
        "profile_quantile_sketch": _quantile_sketch,
        "profile_null_counts": lambda w: _per_table(w, profile.null_counts),
        "profile_sample": lambda w: profile.over_tables(
            [profile.sample_rows(w.bronze(t.name), t.name, t.key) for t in TABLES.values()]
        ),
        "profile_strata_sample": _strata_sample,
        "dq_not_null": quality.not_null,
        "dq_unique": quality.unique,
        "dq_relationships": quality.relationships,
        "dq_ranges": quality.ranges,
        "dq_accepted_values": quality.accepted_values,
        "dq_reconcile": quality.reconcile,
        "dq_score": quality.score,
        "dash_executive": lambda w: dashboards.executive_overview(w.mart("fct_sales")),
        "dash_revenue_by_product": lambda w: dashboards.revenue_by_product(
            w.mart("fct_sales"), w.mart("dim_part")
        ),
        "dash_top_customers": lambda w: dashboards.top_customers(
            w.mart("fct_sales"), w.mart("dim_customer")
        ),
        "dash_revenue_trend": lambda w: dashboards.revenue_trend(
            w.mart("fct_sales"), w.mart("dim_date")
        ),
        "dash_inventory": lambda w: dashboards.inventory_overview(w.mart("fct_inventory")),
        "dash_supplier_performance": lambda w: dashboards.supplier_performance(
            w.mart("fct_revenue_by_supplier"), w.mart("dim_supplier")
        ),
        "dash_delivery_times": lambda w: dashboards.delivery_times(w.mart("fct_sales")),
        "dash_ship_lag": lambda w: dashboards.ship_lag(w.mart("fct_sales")),
    }
    for table in TABLES:
        named[f"bronze_conform_{table}"] = lambda w, t=table: w.bronze(t)
        named[f"silver_{table}"] = lambda w, t=table: w.silver(t)
        named[f"stg_{table}"] = lambda w, t=table: w.staging(t)
    for table in ("lineitem", "part", "partsupp"):
        named[f"silver_strict_{table}"] = lambda w, t=table: w.silver(t, "strict")
    for mart in MARTS:
        named[mart] = lambda w, m=mart: w.mart(m)
    queries = {name: _over_directory(build) for name, build in named.items()}
    queries["bronze_concat_chunks"] = _concat_chunks
    return queries


def _per_table(warehouse: Warehouse, operator: Callable[..., DataFrame]) -> DataFrame:
    return profile.over_tables([operator(warehouse.bronze(t), t) for t in TABLES])


def _over_directory(build: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: as_doubles(build(open_warehouse(spark, sf_dir)))


def _strata_sample(warehouse: Warehouse) -> DataFrame:
    """Some rows of every stratum of the tables that have strata."""
    found = []
    for table, stratum in STRATA.items():
        key = TABLES[table].key
        sample = profile.hash_sample(warehouse.bronze(table), key, STRATUM_ROWS, (stratum,))
        found.append(profile.sample_cells(sample, table, key, stratum))
    return profile.over_tables(found)


def _sketches(warehouse: Warehouse) -> DataFrame:
    """Every table sketched in parts, and the sketches merged."""
    parts = []
    for table, spec in TABLES.items():
        df, dealt = warehouse.bronze(table), F.pmod(F.hash(spec.key[0]), F.lit(SKETCH_PARTS))
        parts += [sketches.sketched(df.where(dealt == p), table, str(p)) for p in range(SKETCH_PARTS)]
    return sketches.merged(profile.over_tables(parts))


def _distinct_sketch(warehouse: Warehouse) -> DataFrame:
    """Exact distinct values, and whether the estimates of merged sketches are near enough."""
    exact = _per_table(warehouse, profile.cardinality)
    found = sketches.distinct_estimates(_sketches(warehouse)).withColumnRenamed("distinct_values", "found")
    off = F.abs(F.col("found") - F.col("distinct_values"))
    near = off <= F.greatest(F.lit(1), F.col("distinct_values") * sketches.DISTINCT_ERROR)
    return exact.join(found, ["table_name", "column_name"]).select(
        "table_name", "column_name", "distinct_values", near.alias("near")
    )


def _quantile_sketch(warehouse: Warehouse) -> DataFrame:
    """Values of numeric columns, and whether each quantile's rank is near enough.

    A value is placed among all quantiles of its column at once: it is above the first ``above`` of
    them and not below the first ``upto``.  The places are few, and give the rank of each quantile.
    Columns travel as numbers beside the values.
    """
    names = ["table_name", "column_name"]
    fields = [(t, f) for t in TABLES for f in warehouse.bronze(t).schema.fields if sketches.number_of(f)]
    numbers = {(t, f.name): i for i, (t, f) in enumerate(fields)}
    cases = " ".join(
        f"WHEN table_name = '{t}' AND column_name = '{c}' THEN {i}" for (t, c), i in numbers.items()
    )
    rising = Window.partitionBy(*names).orderBy("probability")
    found = sketches.quantiles(_sketches(warehouse)).select(
        "*", F.expr(f"CASE {cases} END").alias("column_no"), F.row_number().over(rising).alias("turn")
    )
    found = stored(found, "quantiles")
    turns = range(1, len(sketches.PROBABILITIES) + 1)
    beside = found.groupBy("column_no").pivot("turn", list(turns)).agg(F.first("quantile"))
    values = profile.over_tables([_numbers(warehouse.bronze(t), t, numbers) for t in TABLES])
    above = " + ".join(f"IF(value > `{i}`, 1, 0)" for i in turns)
    upto = " + ".join(f"IF(value >= `{i}`, 1, 0)" for i in turns)
    places = (
        values.join(F.broadcast(beside), "column_no")  # a row per column
        .selectExpr("column_no", f"{above} AS above", f"{upto} AS upto")
        .groupBy("column_no", "above", "upto")
        .agg(F.count(F.lit(1)).alias("values"))
    )
    below = F.when(F.col("upto") < F.col("turn"), F.col("values")).otherwise(0)
    not_above = F.when(F.col("above") < F.col("turn"), F.col("values")).otherwise(0)
    ranked = (
        places.join(F.broadcast(found), "column_no")  # five rows a column
        .groupBy(*names, "probability")
        .agg(F.sum("values").alias("n"), F.sum(below).alias("below"), F.sum(not_above).alias("not_above"))
    )
    at, least, most = F.col("probability"), F.col("below") / F.col("n"), F.col("not_above") / F.col("n")
    near = (least <= at + sketches.RANK_ERROR) & (most >= at - sketches.RANK_ERROR)
    return ranked.select(*names, "probability", F.col("n").alias("value_count"), near.alias("near"))


def _numbers(df: DataFrame, table: str, numbers: dict[tuple[str, str], int]) -> DataFrame:
    """(column_no, value) of every number and date."""
    cells = [
        f"{numbers[table, f.name]}, {n}" for f in df.schema.fields if (n := sketches.number_of(f))
    ]
    return df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (column_no, value)").where(
        "value IS NOT NULL"
    )


def _keyed(warehouse: Warehouse) -> list[chunks.Keyed]:
    return chunks.keyed([(warehouse.bronze(t.name), t) for t in TABLES.values()], CHUNK_ROWS)


def _chunk_cover(warehouse: Warehouse) -> DataFrame:
    """What the manifest of each table covers."""
    counts = [profile.row_counts(warehouse.bronze(t), t) for t in TABLES]
    return chunks.cover(chunks.manifest(_keyed(warehouse)), profile.over_tables(counts))


def _concat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, read in ranges of the manifest and put together again."""
    raw, spec = stock.reader(spark, sf_dir)("lineitem"), TABLES["lineitem"]
    found = chunks.chunk_manifest(raw, spec, CHUNK_ROWS)
    frames = chunks.scans(raw, spec.key[0], found, CHUNK_SCANS)
    return as_doubles(bronze.conform(bronze.concat(frames), "lineitem"))


def _ingest_report(warehouse: Warehouse) -> DataFrame:
    """What the ingest reports of each table; nothing is written."""
    counts = {t: lambda t=t: warehouse.bronze(t).count() for t in TABLES}
    return pipeline.report(warehouse.bronze("region").sparkSession, counts)
