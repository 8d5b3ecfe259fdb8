import datetime as dt
from decimal import Decimal

from checks import stock
from goldseam.operators import bronze
from goldseam.schemas import TABLES
from tests.frames import bronze as frame
from tests.frames import line


def test_upper_case_columns_become_lower_case_once(spark):
    df = spark.createDataFrame([(7, "PERU")], "N_NATIONKEY int, N_NAME string")
    out = bronze.conform(df, "nation")
    assert out.columns == list(TABLES["nation"].columns)
    assert out.first().asDict() == {
        "n_nationkey": 7,
        "n_name": "PERU",
        "n_regionkey": None,
        "n_comment": None,
    }


def test_declared_types(spark):
    df = spark.createDataFrame(
        [(1, 10.005, dt.datetime(1998, 1, 2, 13), "x")],
        "o_orderkey int, o_totalprice double, o_orderdate timestamp_ntz, o_more string",
    )
    out = bronze.conform(df, "orders")
    assert out.schema[:9] == TABLES["orders"].schema
    row = out.first()
    assert row.o_totalprice == Decimal("10.01")
    assert row.o_orderdate == dt.date(1998, 1, 2)
    assert row.o_more == "x"


def test_typed_columns_pass_through_unchanged(spark, tmp_path):
    frame(spark, "orders", [{"o_orderkey": 1, "o_totalprice": 5}]).write.parquet(f"{tmp_path}/o")
    out = bronze.conform(spark.read.parquet(f"{tmp_path}/o"), "orders")
    plan = out.filter("o_totalprice > 3")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,3.00)" in plan


def test_derived_stock_is_one_row_per_pair(spark):
    lines = [line(1, l_partkey=p, l_suppkey=s) for p, s in [(0, 0), (3, 1), (3, 1), (2, 5)]]
    rows = stock.stock_from_lines(frame(spark, "lineitem", lines)).collect()
    assert {(r.ps_partkey, r.ps_suppkey): (r.ps_availqty, r.ps_supplycost) for r in rows} == {
        (0, 0): (Decimal("0.00"), Decimal("1.00")),
        (3, 1): (Decimal("4.00"), Decimal("3.56")),
        (2, 5): (Decimal("1172.00"), Decimal("6.91")),
    }
    assert len(rows) == 3


def test_chunks_are_put_together_by_name(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([("b", 2)], "v string, k int")
    assert sorted(map(tuple, bronze.concat([a, b]).collect())) == [(1, "a"), (2, "b")]
