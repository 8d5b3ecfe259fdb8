from decimal import Decimal

import pytest

from goldseam.operators import dashboards, dimensions, facts
from tests.frames import day, line, order, staged


def sales(spark, lines, orders):
    return facts.fct_sales(staged(spark, "lineitem", lines), staged(spark, "orders", orders))


def test_staging_renames_views_over_stored_silver(spark, tmp_path):
    from goldseam.operators import silver, staging
    from tests.frames import bronze

    for table in staging.RENAMES:
        silver.clean(bronze(spark, table, []), table).write.parquet(f"{tmp_path}/{table}")
    views = staging.create_views(spark, str(tmp_path))
    assert sorted(views) == sorted(f"stg_{t}" for t in staging.RENAMES)
    for table, renames in staging.RENAMES.items():
        assert spark.table(f"stg_{table}").columns == list(renames.values())


def test_dimension_misses_keep_the_row(spark):
    customers = [{"c_custkey": k, "c_nationkey": n} for k, n in [(1, 1), (2, 9), (3, None), (4, 2)]]
    nations = [
        {"n_nationkey": 1, "n_name": "PERU", "n_regionkey": 1},
        {"n_nationkey": 2, "n_name": "LOST", "n_regionkey": 8},
    ]
    regions = [{"r_regionkey": 1, "r_name": "AMERICA"}]
    out = dimensions.dim_customer(
        staged(spark, "customer", customers),
        staged(spark, "nation", nations),
        staged(spark, "region", regions),
    )
    found = {
        r.customer_key: (r.nation_key, r.nation_name, r.region_key, r.region_name)
        for r in out.collect()
    }
    assert found == {
        1: (1, "PERU", 1, "AMERICA"),
        2: (9, None, None, None),
        3: (None, None, None, None),
        4: (2, "LOST", 8, None),
    }


def test_date_spine(spark):
    orders = [order(1, o_orderdate=day("1998-12-31")), order(2, o_orderdate=day("1999-01-04"))]
    rows = dimensions.dim_date(staged(spark, "orders", orders)).orderBy("date_key").collect()
    assert [str(r.date_key) for r in rows] == [
        "1998-12-31",
        "1999-01-01",
        "1999-01-02",
        "1999-01-03",
        "1999-01-04",
    ]
    assert rows[1].week_of_year == 53
    assert [r.is_weekend for r in rows] == [False, False, True, True, False]
    assert [r.day_of_week for r in rows] == [5, 6, 7, 1, 2]


def test_no_orders_no_dates(spark):
    assert dimensions.dim_date(staged(spark, "orders", [])).count() == 0


def test_sales_need_both_line_and_order(spark):
    out = sales(spark, [line(1), line(2), line(None)], [order(1), order(3)])
    assert [r.order_key for r in out.collect()] == [1]


def test_sales_prices(spark):
    lines = [line(1, l_extendedprice="100.01", l_discount="0.07", l_tax="0.03")]
    row = sales(spark, lines, [order(1)]).first()
    assert row.net_price == Decimal("93.0093")
    assert row.total_price == Decimal("95.799579")
    assert row.discount_amount == Decimal("7.0007")
    assert row.order_total_price == Decimal("10.00")


@pytest.mark.parametrize(
    "net, tier",
    [
        ("10000", "Low Performer"),
        ("10000.01", "Medium Performer"),
        ("50000", "Medium Performer"),
        ("50000.01", "High Performer"),
        (None, "Low Performer"),
    ],
)
def test_performance_tier(spark, net, tier):
    out = facts.fct_revenue_by_supplier(
        sales(spark, [line(1, l_extendedprice=net)], [order(1)])
    )
    assert out.first().performance_tier == tier


def test_zero_gross_has_no_discount_rate(spark):
    out = facts.fct_revenue_by_supplier(sales(spark, [line(1, l_extendedprice=0)], [order(1)]))
    row = out.first()
    assert row.discount_rate is None
    assert row.revenue_per_order == 0


def test_daily_revenue(spark):
    lines = [
        line(1, l_extendedprice=100, l_discount="0.1"),
        line(1, l_linenumber=2, l_extendedprice=50, l_discount=0),
        line(2, l_extendedprice=None, l_discount=0),
        line(3, l_suppkey=2),
    ]
    orders = [order(1), order(2), order(3)]
    out = facts.fct_revenue_by_supplier(sales(spark, lines, orders))
    row = out.filter("supplier_key = 1").first()
    assert (row.total_orders, row.total_line_items) == (2, 3)
    assert row.revenue == 140
    assert row.gross_revenue == 150
    assert row.avg_line_value == 75
    assert (row.max_line_value, row.min_line_value) == (100, 50)
    assert row.revenue_per_order == 70
    assert row.revenue_per_line == Decimal("46.666667")
    assert row.discount_rate == Decimal("0.066667")
    assert out.count() == 2


def test_inventory_levels(spark):
    part = [{"p_partkey": 1, "p_retailprice": 100}]
    stock = [
        {"ps_partkey": p, "ps_suppkey": i, "ps_availqty": q, "ps_supplycost": c}
        for i, (p, q, c) in enumerate(
            [
                (1, 100, "49.99"),
                (1, 101, "50"),
                (1, 1000, "69.99"),
                (1, 1001, "70"),
                (2, None, "1"),
                (None, 5, "1"),
            ]
        )
    ]
    supplier = dimensions.dim_supplier(
        staged(spark, "supplier", [{"s_suppkey": 0, "s_name": "S"}]),
        staged(spark, "nation", []),
        staged(spark, "region", []),
    )
    out = facts.fct_inventory(
        staged(spark, "partsupp", stock),
        dimensions.dim_part(staged(spark, "part", part)),
        supplier,
    ).orderBy("supplier_key")
    rows = out.collect()
    assert [r.stock_level.split()[0] for r in rows] == [
        "Low", "Medium", "Medium", "High", "Low", "Low",
    ]
    assert [r.cost_category.split()[0] for r in rows] == [
        "Low", "Medium", "Medium", "High", "High", "High",
    ]
    assert rows[0].supplier_name == "S" and rows[1].supplier_name is None
    assert rows[0].total_inventory_value == Decimal("4999.00")


def test_delivery_times_skip_missing_dates(spark):
    days = {"l_shipdate": day("1998-02-01"), "l_commitdate": day("1998-02-05")}
    lines = [
        line(1, l_shipmode="AIR", l_receiptdate=day("1998-02-05"), **days),
        line(1, l_shipmode="AIR", l_receiptdate=day("1998-02-11"), **days),
        line(1, l_shipmode="AIR", **days),
        line(1, l_shipmode="RAIL", **days),
    ]
    out = dashboards.delivery_times(sales(spark, lines, [order(1)]))
    assert {tuple(r) for r in out.collect()} == {("AIR", 3, 7.0, 0.5), ("RAIL", 1, None, None)}


def test_top_customers_break_ties_by_key_and_keep_unknown_customers(spark):
    lines = [line(k, l_extendedprice=p) for k, p in [(1, 5), (2, 9), (3, 9), (4, 1)]]
    orders = [order(k, o_custkey=10 - k) for k in (1, 2, 3, 4)]
    customer = dimensions.dim_customer(
        staged(spark, "customer", [{"c_custkey": 7, "c_name": "N"}]),
        staged(spark, "nation", []),
        staged(spark, "region", []),
    )
    out = dashboards.top_customers(sales(spark, lines, orders), customer, n=3)
    assert [(r.customer_key, r.customer_name) for r in out.collect()] == [
        (7, "N"), (8, None), (9, None),
    ]


def test_executive_overview_counts_orders_once(spark):
    lines = [line(1), line(1, l_linenumber=2), line(2)]
    orders = [order(1), order(1, o_custkey=2), order(2)]
    row = dashboards.executive_overview(sales(spark, lines, orders)).first()
    assert (row.total_orders, row.total_customers, row.total_line_items) == (2, 2, 5)
    assert row.avg_order_value == 250
