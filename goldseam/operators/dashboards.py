"""Business questions over the star schema.

Each one aggregates the fact to the key of its dimension first and joins afterwards, so the
join carries one row per key instead of one per sale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def executive_overview(sales: DataFrame) -> DataFrame:
    """Core metrics in one row.

    Sums need no key and are combined on the map side.  Distinct orders and customers are counted
    over narrow (kind, key) pairs, so no measure is shuffled for them.
    """
    sums = sales.agg(
        F.count(F.lit(1)).alias("total_line_items"),
        F.sum("net_price").alias("net_revenue"),
        F.sum("extended_price").alias("gross_revenue"),
        F.sum("discount_amount").alias("total_discount"),
    )
    kinds = ("total_orders", "total_customers")
    pairs = sales.selectExpr("stack(2, 0, order_key, 1, customer_key) AS (kind, key)")
    distinct = (
        pairs.filter(F.col("key").isNotNull())
        .distinct()
        .agg(*(F.count_if(F.col("kind") == i).alias(name) for i, name in enumerate(kinds)))
    )
    # Two results of one row each, put side by side.
    names = [*kinds, *sums.columns]
    both = sums.unionByName(distinct, allowMissingColumns=True)
    totals = both.agg(*(F.max(name).alias(name) for name in names))
    return totals.select(
        "*",
        F.try_divide("net_revenue", "total_orders").alias("avg_order_value"),
        F.try_divide("total_discount", "gross_revenue").alias("discount_rate"),
    )


def revenue_by_product(sales: DataFrame, dim_part: DataFrame) -> DataFrame:
    per_part = sales.groupBy("part_key").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("net_price").alias("net"),
    )
    return (
        per_part.join(dim_part.select("part_key", "brand", "type"), "part_key", "left")
        .groupBy("brand", "type")
        .agg(
            F.sum("lines").alias("total_line_items"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("net").alias("net_revenue"),
        )
    )


def top_customers(sales: DataFrame, dim_customer: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` customers with most revenue; ties go to the smaller key."""
    ranked = (
        sales.groupBy("customer_key")
        .agg(F.sum("net_price").alias("net_revenue"), F.count(F.lit(1)).alias("total_line_items"))
        .orderBy(F.desc("net_revenue"), "customer_key")
        .limit(n)
    )
    # At most n keys, so the dimension is reduced to them where it lies, without a shuffle.
    described = dim_customer.join(
        F.broadcast(ranked.select("customer_key")), "customer_key", "left_semi"
    ).select("customer_key", "customer_name", "market_segment", "nation_name", "region_name")
    return ranked.join(described, "customer_key", "left").orderBy(
        F.desc("net_revenue"), "customer_key"
    )


def revenue_trend(sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    per_day = sales.groupBy(F.col("order_date").alias("date_key")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("net_price").alias("net")
    )
    return (
        per_day.join(dim_date.select("date_key", "year", "month"), "date_key", "left")
        .groupBy("year", "month")
        .agg(F.sum("lines").alias("total_line_items"), F.sum("net").alias("net_revenue"))
    )


def inventory_overview(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("stock_level", "cost_category").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("available_qty").alias("total_quantity"),
        F.sum("total_inventory_value").alias("total_inventory_value"),
    )


def supplier_performance(revenue: DataFrame, dim_supplier: DataFrame) -> DataFrame:
    per_supplier = revenue.groupBy("supplier_key", "performance_tier").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("total_orders").alias("orders"),
        F.sum("revenue").alias("net"),
    )
    regions = dim_supplier.select("supplier_key", "region_name")
    return (
        per_supplier.join(regions, "supplier_key", "left")
        .groupBy("performance_tier", "region_name")
        .agg(
            F.sum("days").alias("supplier_days"),
            F.sum("orders").alias("total_orders"),
            F.sum("net").alias("net_revenue"),
        )
    )


def delivery_times(sales: DataFrame) -> DataFrame:
    """Mean days from shipping to receipt and share received late, per ship mode."""
    late = F.when(F.col("receipt_date") > F.col("commit_date"), 1).when(
        F.col("receipt_date") <= F.col("commit_date"), 0
    )
    return sales.groupBy("ship_mode").agg(
        F.count(F.lit(1)).alias("total_line_items"),
        _mean(F.datediff("receipt_date", "ship_date")).alias("avg_delivery_days"),
        _mean(late).alias("late_share"),
    )


def ship_lag(sales: DataFrame) -> DataFrame:
    """Mean days from order to shipping, per order priority."""
    lag = F.datediff("ship_date", "order_date")
    return sales.groupBy("order_priority").agg(
        F.count(F.lit(1)).alias("total_line_items"),
        _mean(lag).alias("avg_ship_days"),
        F.min(lag).alias("min_ship_days"),
        F.max(lag).alias("max_ship_days"),
    )


def _mean(value: Column) -> Column:
    """Mean of whole numbers as one exact sum and one division; NULL without values."""
    return F.try_divide(F.sum(value), F.count(value))
