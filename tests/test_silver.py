import pytest
from pyspark.sql import functions as F

from goldseam.operators import silver
from tests.frames import bronze, clean, day, line, order


def column(df, name):
    return [r[name] for r in df.collect()]


def test_trim_takes_spaces_and_strip_takes_all_whitespace(spark):
    raw = ["  ASIA ", "\tASIA\n", "　ASIA ", " \x0bASIA\x85 "]
    rows = [{"r_regionkey": i, "r_name": n} for i, n in enumerate(raw)]
    out = clean(spark, "region", rows).orderBy("r_regionkey")
    assert column(out, "r_name") == ["ASIA", "\tASIA\n", "　ASIA ", "\x0bASIA\x85"]
    assert column(out, "r_name_clean") == ["ASIA"] * 4


@pytest.mark.parametrize(
    "table, trimmed",
    [(name, cleaning.trim) for name, cleaning in silver.CLEANING.items()],
)
def test_every_listed_column_is_trimmed(spark, table, trimmed):
    extra = {"o_totalprice": 1} if table == "orders" else {}
    row = clean(spark, table, [{c: "  x y " for c in trimmed} | extra]).first()
    assert [row[c] for c in trimmed] == ["x y"] * len(trimmed)


@pytest.mark.parametrize("table, prefix", [("customer", "c"), ("supplier", "s")])
def test_account_status(spark, table, prefix):
    rows = [{f"{prefix}_acctbal": b} for b in (-0.01, 0, None)]
    out = clean(spark, table, rows)
    assert column(out, f"{prefix}_acctbal_status") == ["NEGATIVE", "POSITIVE", "POSITIVE"]


def test_size_category(spark):
    out = clean(spark, "part", [{"p_size": s} for s in (9, 10, 29, 30, None)])
    assert column(out, "p_size_category") == ["SMALL", "MEDIUM", "MEDIUM", "LARGE", "LARGE"]


def test_orders_need_a_positive_total_under_both_rule_sets(spark):
    rows = [order(i, o_totalprice=p) for i, p in enumerate((-1, 0, 0.01, None))]
    for rules in silver.RULE_SETS:
        assert column(clean(spark, "orders", rows, rules), "o_orderkey") == [2]


def test_order_year_and_quarter(spark):
    row = clean(spark, "orders", [order(1, o_orderdate=day("1998-11-30"))]).first()
    assert (row.o_year, row.o_quarter) == (1998, 4)


def test_lineitem_derivations(spark):
    rows = [line(1, l_extendedprice=200, l_discount=0.05, l_shipdate=day("1997-02-01"))]
    row = clean(spark, "lineitem", rows).first()
    assert float(row.l_discount_percentage) == 5
    assert float(row.l_net_price) == 190
    assert row.l_ship_year == 1997


def test_strict_rules(spark):
    lines = [line(i, l_quantity=q) for i, q in enumerate((0, 1, None))]
    assert column(clean(spark, "lineitem", lines, "strict"), "l_orderkey") == [1]
    assert clean(spark, "lineitem", lines).count() == 3
    parts = [{"p_partkey": p, "p_retailprice": p} for p in (0, 1)]
    assert column(clean(spark, "part", parts, "strict"), "p_partkey") == [1]
    stock = [
        {"ps_partkey": 1, "ps_availqty": -1, "ps_supplycost": 1},
        {"ps_partkey": 2, "ps_availqty": 0, "ps_supplycost": 1},
        {"ps_partkey": 3, "ps_availqty": 0, "ps_supplycost": 0},
    ]
    assert column(clean(spark, "partsupp", stock, "strict"), "ps_partkey") == [2]


def test_unknown_rules_are_refused(spark):
    with pytest.raises(ValueError, match="lenient"):
        clean(spark, "part", [], "lenient")


def test_row_delta(spark):
    lines = [line(i, l_quantity=q) for i, q in enumerate((0, 1, None))]
    row = silver.row_delta(bronze(spark, "lineitem", lines), "lineitem").first()
    assert tuple(row) == ("lineitem", 3, 3, 1)


def test_both_filters_apply_where_both_are_set(monkeypatch):
    both = silver.Cleaning(keep=lambda: F.col("a") > 0, keep_strict=lambda: F.col("b") > 0)
    monkeypatch.setitem(silver.CLEANING, "region", both)
    assert "AND" not in str(silver.row_filter("region")).upper()
    strict = str(silver.row_filter("region", "strict"))
    assert "a" in strict and "b" in strict
