"""Gold facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam import functions as fn

MEAN_PRICE = "decimal(19,6)"  # what avg gives for a price


def fct_sales(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with the context of their order; lines without an order drop out.

    One shuffle of each side on the order key, which later aggregates by order reuse.  Orders
    grow with the lines, so they are never broadcast; a hot order key is split by adaptive
    skew handling.
    """
    context = orders.select(
        "order_key",
        "customer_key",
        "order_date",
        "order_status",
        "order_priority",
        F.col("total_price").alias("order_total_price"),
    )
    price, discount, tax = F.col("extended_price"), F.col("discount"), F.col("tax")
    return lineitem.join(context.hint("merge"), "order_key", "inner").select(
        "order_key",
        "line_number",
        "customer_key",
        "part_key",
        "supplier_key",
        "order_date",
        "ship_date",
        "quantity",
        "extended_price",
        "discount",
        "tax",
        fn.net_price(price, discount).alias("net_price"),
        fn.total_price(price, discount, tax).alias("total_price"),
        fn.discount_amount(price, discount).alias("discount_amount"),
        "order_status",
        "order_priority",
        "order_total_price",
        "return_flag",
        "line_status",
        "ship_mode",
        "commit_date",
        "receipt_date",
    )


def fct_revenue_by_supplier(sales: DataFrame) -> DataFrame:
    """Daily sales of each supplier.

    The exact distinct order count makes Spark pre-aggregate by (supplier, day, order) before
    it merges by (supplier, day), so a hot supplier-day is spread over its orders.  The mean
    price comes from the sum that is there anyway: a wide decimal sum is the dearest part.

    Nearly every line is a group of its own in those first aggregates.  By hashing, each of them
    would hold all groups of a task with their wide sums.  A key carried along as a struct makes
    Spark aggregate in key order instead: one sort of the narrow lines, which can spill, serves
    all of them, so the measures are computed from their inputs after it.
    """
    price, discount, tax = F.col("extended_price"), F.col("discount"), F.col("tax")
    day = F.col("order_date").alias("date_key")
    daily = sales.groupBy("supplier_key", day).agg(
        F.max(F.struct("supplier_key", day)).alias("key"),
        F.count_distinct("order_key").alias("total_orders"),
        F.count(F.lit(1)).alias("total_line_items"),
        F.sum("quantity").alias("total_quantity"),
        F.sum(fn.net_price(price, discount)).alias("revenue"),
        F.sum("extended_price").alias("gross_revenue"),
        F.sum(fn.total_price(price, discount, tax)).alias("total_revenue"),
        F.sum(fn.discount_amount(price, discount)).alias("total_discount"),
        F.count("extended_price").alias("priced_lines"),
        F.max("extended_price").alias("max_line_value"),
        F.min("extended_price").alias("min_line_value"),
    )
    return daily.select(
        "key.supplier_key",
        "key.date_key",
        "total_orders",
        "total_line_items",
        "total_quantity",
        "revenue",
        "gross_revenue",
        "total_revenue",
        "total_discount",
        F.try_divide("gross_revenue", "priced_lines").cast(MEAN_PRICE).alias("avg_line_value"),
        "max_line_value",
        "min_line_value",
        F.try_divide("revenue", "total_orders").alias("revenue_per_order"),
        F.try_divide("revenue", "total_line_items").alias("revenue_per_line"),
        F.try_divide("total_discount", "gross_revenue").alias("discount_rate"),
        fn.performance_tier(F.col("revenue")).alias("performance_tier"),
    )


def fct_inventory(partsupp: DataFrame, dim_part: DataFrame, dim_supplier: DataFrame) -> DataFrame:
    """Stock of each part at each supplier; unknown parts and suppliers keep their row."""
    parts = dim_part.select(
        "part_key",
        F.col("name").alias("part_name"),
        F.col("mfgr").alias("part_mfgr"),
        F.col("brand").alias("part_brand"),
        F.col("type").alias("part_type"),
        "retail_price",
    )
    suppliers = dim_supplier.select(
        "supplier_key",
        "supplier_name",
        F.col("nation_name").alias("supplier_nation"),
        F.col("region_name").alias("supplier_region"),
    )
    quantity, cost = F.col("available_qty"), F.col("supply_cost")
    return (
        partsupp.join(parts, "part_key", "left")
        .join(suppliers, "supplier_key", "left")
        .select(
            "part_key",
            "supplier_key",
            "available_qty",
            "supply_cost",
            (quantity * cost).alias("total_inventory_value"),
            "part_name",
            "part_mfgr",
            "part_brand",
            "part_type",
            "retail_price",
            "supplier_name",
            "supplier_nation",
            "supplier_region",
            fn.stock_level(quantity).alias("stock_level"),
            fn.cost_category(cost, F.col("retail_price")).alias("cost_category"),
        )
    )
