"""Gold dimensions.

Nation and region carry no broadcast hint: Spark broadcasts them when their measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam import functions as fn


def _geography(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nations with their region's name; joined first, so the large side is probed once."""
    return nation.select("nation_key", "nation_name", "region_key").join(
        region.select("region_key", "region_name"), "region_key", "left"
    )


def dim_customer(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return customer.join(_geography(nation, region), "nation_key", "left").select(
        "customer_key",
        "customer_name",
        "customer_address",
        "market_segment",
        "nation_key",
        "nation_name",
        "region_key",
        "region_name",
        "customer_phone",
        "account_balance",
        "account_balance_status",
        "customer_comment",
    )


def dim_supplier(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return supplier.join(_geography(nation, region), "nation_key", "left").select(
        "supplier_key",
        "supplier_name",
        "supplier_address",
        "nation_key",
        "nation_name",
        "region_key",
        "region_name",
        "supplier_phone",
        "account_balance",
        "supplier_comment",
    )


def dim_part(part: DataFrame) -> DataFrame:
    return part.select(
        "part_key",
        F.col("part_name").alias("name"),
        F.col("manufacturer").alias("mfgr"),
        "brand",
        F.col("part_type").alias("type"),
        F.col("part_size").alias("size"),
        "container",
        "retail_price",
        "part_comment",
    )


def dim_date(orders: DataFrame) -> DataFrame:
    """Every day from the first order to the last; no orders, no days."""
    span = orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    days = span.select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date_key")
    )
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.month("date_key").alias("month"),
        F.day("date_key").alias("day"),
        F.quarter("date_key").alias("quarter"),
        F.weekofyear("date_key").alias("week_of_year"),
        F.dayofweek("date_key").alias("day_of_week"),
        fn.is_weekend(F.col("date_key")).alias("is_weekend"),
    )
