"""Staging: Silver columns under business names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Silver column -> business name, per table, in output order.
RENAMES: dict[str, dict[str, str]] = {
    "customer": {
        "c_custkey": "customer_key",
        "c_name": "customer_name",
        "c_address": "customer_address",
        "c_nationkey": "nation_key",
        "c_phone": "customer_phone",
        "c_acctbal": "account_balance",
        "c_mktsegment": "market_segment",
        "c_comment": "customer_comment",
        "c_acctbal_status": "account_balance_status",
    },
    "lineitem": {
        "l_orderkey": "order_key",
        "l_partkey": "part_key",
        "l_suppkey": "supplier_key",
        "l_linenumber": "line_number",
        "l_quantity": "quantity",
        "l_extendedprice": "extended_price",
        "l_discount": "discount",
        "l_tax": "tax",
        "l_returnflag": "return_flag",
        "l_linestatus": "line_status",
        "l_shipdate": "ship_date",
        "l_commitdate": "commit_date",
        "l_receiptdate": "receipt_date",
        "l_shipinstruct": "ship_instruct",
        "l_shipmode": "ship_mode",
        "l_comment": "lineitem_comment",
        "l_discount_percentage": "discount_percentage",
    },
    "nation": {
        "n_nationkey": "nation_key",
        "n_name": "nation_name",
        "n_regionkey": "region_key",
        "n_comment": "nation_comment",
    },
    "orders": {
        "o_orderkey": "order_key",
        "o_custkey": "customer_key",
        "o_orderstatus": "order_status",
        "o_totalprice": "total_price",
        "o_orderdate": "order_date",
        "o_orderpriority": "order_priority",
        "o_clerk": "clerk",
        "o_shippriority": "ship_priority",
        "o_comment": "order_comment",
        "o_year": "order_year",
        "o_quarter": "order_quarter",
    },
    "part": {
        "p_partkey": "part_key",
        "p_name": "part_name",
        "p_mfgr": "manufacturer",
        "p_brand": "brand",
        "p_type": "part_type",
        "p_size": "part_size",
        "p_container": "container",
        "p_retailprice": "retail_price",
        "p_comment": "part_comment",
    },
    "partsupp": {
        "ps_partkey": "part_key",
        "ps_suppkey": "supplier_key",
        "ps_availqty": "available_qty",
        "ps_supplycost": "supply_cost",
        "ps_comment": "partsupp_comment",
    },
    "region": {
        "r_regionkey": "region_key",
        "r_name": "region_name",
        "r_comment": "region_comment",
    },
    "supplier": {
        "s_suppkey": "supplier_key",
        "s_name": "supplier_name",
        "s_address": "supplier_address",
        "s_nationkey": "nation_key",
        "s_phone": "supplier_phone",
        "s_acctbal": "account_balance",
        "s_comment": "supplier_comment",
    },
}


def stage(silver: DataFrame, table: str) -> DataFrame:
    return silver.select(*(F.col(c).alias(name) for c, name in RENAMES[table].items()))


def create_views(spark: SparkSession, silver_root: str) -> list[str]:
    """One temporary view ``stg_<table>`` per table, straight over the stored Silver files."""
    views = []
    for table, renames in RENAMES.items():
        columns = ", ".join(f"{c} AS {name}" for c, name in renames.items())
        path = f"{silver_root.rstrip('/')}/{table}"
        spark.sql(f"SELECT {columns} FROM parquet.`{path}`").createOrReplaceTempView(f"stg_{table}")
        views.append(f"stg_{table}")
    return views
