"""Physical plans: what is read, shuffled and broadcast, and what skew does to them."""

import re

import pytest
from pyspark.sql import functions as F

from checks import queries, stock
from goldseam.operators import dashboards, facts, quality, silver, staging
from goldseam.plans.warehouse import Warehouse, bronze_of
from goldseam.session import sized
from tests.conftest import SMALL

NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def new_warehouse(spark):
    """One whose frames were not planned under the options of another test."""
    return Warehouse(bronze=bronze_of(stock.reader(spark, SMALL)))


@pytest.fixture
def warehouse(spark):
    return new_warehouse(spark)


def read_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", text)]


def test_flagship_reads_only_what_it_needs(spark, warehouse):
    line, order = read_columns(plan(warehouse.mart("fct_revenue_by_supplier")))
    assert line == {
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    }
    assert order == {"o_orderkey", "o_totalprice", "o_orderdate"}


def test_no_query_runs_python_or_a_cartesian_product(spark):
    for name, query in queries.registered().items():
        text = plan(query(spark, SMALL))
        for operator in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoop"):
            assert operator not in text, (name, operator)


def test_flagship_shuffles_lines_once(spark, warehouse, conf):
    """The (supplier, day, order) aggregate reuses the join's partitioning by order."""
    conf(**NO_BROADCAST, spark__sql__adaptive__enabled="false")
    text = plan(warehouse.mart("fct_revenue_by_supplier"))
    assert re.findall(r"Exchange hashpartitioning\((\w+?)_key#", text) == [
        "supplier",
        "order",
        "order",
    ]


def test_revenue_holds_no_group_per_line_in_memory(spark, warehouse):
    """Aggregates with a group per line run in key order; also with the extremes pruned away."""
    revenue = warehouse.mart("fct_revenue_by_supplier")
    for df in (revenue, revenue.select("supplier_key", "total_orders", "revenue")):
        text = plan(df)
        assert text.count("SortAggregate") >= 4 and "HashAggregate" not in text


def test_supplier_dashboard_holds_no_group_per_line_in_memory(spark, warehouse):
    """The dashboard needs few columns of the fact, and hashes only by supplier and tier."""
    text = plan(
        dashboards.supplier_performance(
            warehouse.mart("fct_revenue_by_supplier"), warehouse.mart("dim_supplier")
        )
    )
    assert text.count("SortAggregate") == 4  # by order twice, by day twice
    for keys in re.findall(r"HashAggregate\(keys=\[(.*?)\]", text):
        assert "order" not in keys and "date" not in keys, keys


def test_revenue_in_key_order_keeps_null_keys_and_repeated_orders(spark):
    from tests.frames import line, order, staged

    lines = [line(k, l_suppkey=s, l_linenumber=n) for k in (1, 2) for s in (None, 5) for n in (1, 2)]
    orders = [order(1), order(1), order(2, o_orderdate=None)]
    sales = facts.fct_sales(staged(spark, "lineitem", lines), staged(spark, "orders", orders))
    found = facts.fct_revenue_by_supplier(sales).select(
        "supplier_key", F.col("date_key").cast("string"), "total_orders", "total_line_items", "revenue"
    )
    assert {tuple(r[:4]): int(r.revenue) for r in found.collect()} == {
        (None, "1998-01-05", 1, 4): 400,
        (5, "1998-01-05", 1, 4): 400,
        (None, None, 1, 2): 200,
        (5, None, 1, 2): 200,
    }


def test_small_dimensions_are_broadcast_by_their_size(spark, warehouse, conf):
    assert final_plan(warehouse.mart("dim_customer")).count("BroadcastHashJoin") == 2
    conf(**NO_BROADCAST)
    fresh = new_warehouse(spark)
    text = final_plan(fresh.mart("dim_customer"))
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 2


def test_row_rules_scan_a_table_once(spark, warehouse):
    rules = quality.not_null_rules(["l_orderkey"]) + quality.range_rules("lineitem")
    text = plan(quality.check_rows(warehouse.bronze("lineitem"), "lineitem", rules))
    assert text.count("FileScan") == 1


def test_references_need_no_join_and_one_scan_per_table(spark, warehouse):
    from goldseam.plans.quality import REFERENCES
    from goldseam.schemas import TABLES

    names = [t for t in TABLES if t != "partsupp"]
    references = [r for r in REFERENCES if r.child in names and r.parent in names]
    text = plan(
        quality.check_references({n: warehouse.silver(n) for n in names}, references)
    )
    assert text.count("FileScan") == len(names)
    assert "Join" not in text
    assert text.count("Exchange") == 3  # the last gathers one row per rule


@pytest.fixture
def hot(spark, tmp_path):
    """A third of all lines belong to one order; orders and lines as stored Silver."""
    rows = 200_000
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_000)
    lines = spark.range(rows, numPartitions=16).select(
        key.cast("bigint").alias("l_orderkey"),
        (F.col("id") % 8).cast("bigint").alias("l_linenumber"),
        (F.col("id") % 100).alias("l_partkey"),
        (F.col("id") % 50).alias("l_suppkey"),
        F.lit(1).cast("decimal(15,2)").alias("l_quantity"),
        (F.col("id") % 1000).cast("decimal(15,2)").alias("l_extendedprice"),
        F.lit("0.05").cast("decimal(15,2)").alias("l_discount"),
        F.lit("0.02").cast("decimal(15,2)").alias("l_tax"),
    )
    orders = spark.range(20_000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 900).alias("o_custkey"),
        F.lit(10).cast("decimal(15,2)").alias("o_totalprice"),
        F.date_add(F.lit("1998-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias(
            "o_orderdate"
        ),
    )
    staged = {}
    for table, df in {"lineitem": lines, "orders": orders}.items():
        from goldseam.operators import bronze

        path = f"{tmp_path}/{table}"
        silver.clean(bronze.conform(df, table), table).write.parquet(path)
        staged[table] = staging.stage(spark.read.parquet(path), table)
    return staged


def test_hot_order_is_split_in_both_facts(spark, hot, conf):
    conf(
        **NO_BROADCAST,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__forceOptimizeSkewedJoin="false",
        spark__sql__shuffle__partitions="16",
    )
    spark.conf.unset("spark.sql.adaptive.forceOptimizeSkewedJoin")
    sales = facts.fct_sales(hot["lineitem"], hot["orders"])
    revenue = facts.fct_revenue_by_supplier(sales)
    with sized(spark):
        assert "skew=true" in final_plan(sales)
        assert "skew=true" in final_plan(revenue)
    totals = revenue.agg(F.sum("total_line_items"), F.sum("gross_revenue")).first()
    assert tuple(totals) == tuple(
        hot["lineitem"].agg(F.count(F.lit(1)), F.sum("extended_price")).first()
    )
    hot_rows = sales.filter("order_key = 7").count()
    assert hot_rows >= 66_666
    assert revenue.agg(F.sum("total_orders")).first()[0] == (
        sales.select("supplier_key", "order_date", "order_key").distinct().count()
    )


def test_hot_keys_reach_quality_shuffles_pre_aggregated(spark, hot):
    df = hot["lineitem"]
    checked = quality.check_unique({"lineitem": (df, ("order_key", "line_number"))})
    text = plan(checked)
    by_key = re.search(r"Exchange hashpartitioning\([^\n]*k0#.*", text, re.S).group()
    assert "HashAggregate" in by_key.split("FileScan")[0]
    row = checked.first()
    assert row.checked == 200_000
    assert row.checked - row.failed == df.select("order_key", "line_number").distinct().count()


def test_overview_multiplies_no_rows(warehouse):
    text = plan(dashboards.executive_overview(warehouse.mart("fct_sales")))
    assert "Expand" not in text


def test_top_customers_shuffle_no_dimension(spark, conf, tmp_path):
    conf(**NO_BROADCAST)
    spark.range(5000).selectExpr(
        "id % 700 AS customer_key", "CAST(id AS DECIMAL(15,2)) AS net_price"
    ).write.parquet(f"{tmp_path}/sales")
    spark.range(700).selectExpr(
        "id AS customer_key", "'c' AS customer_name", "'m' AS market_segment",
        "'n' AS nation_name", "'r' AS region_name",
    ).write.parquet(f"{tmp_path}/customers")
    sales, customers = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("sales", "customers"))
    df = dashboards.top_customers(sales, customers)
    text = plan(df)
    assert "BroadcastHashJoin [customer_key" in text and "LeftSemi" in text
    assert [r.customer_key for r in df.take(2)] == [99, 98]


def test_all_key_rules_scan_a_relation_once(warehouse):
    from goldseam.plans.quality import REFERENCES
    from goldseam.schemas import TABLES

    names = [t for t in TABLES if t != "partsupp"]
    references = [r for r in REFERENCES if r.child in names and r.parent in names]
    text = plan(
        quality.check_keys(
            {n: warehouse.silver(n) for n in names}, {n: TABLES[n].key for n in names}, references
        )
    )
    assert text.count("FileScan") == len(names) and "Join" not in text


def test_cardinality_shuffles_numbers_as_numbers(warehouse):
    from goldseam.operators import profile

    text = plan(profile.cardinality(warehouse.bronze("orders"), "orders"))
    assert "cast(o_orderkey" not in text
    assert text.count("FileScan") == 1
