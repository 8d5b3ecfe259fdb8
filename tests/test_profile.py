from decimal import Decimal

import pytest

from goldseam.operators import profile

ROWS = [(1, "a", Decimal("2.50")), (1, None, None), (2, "7", Decimal("0.50")), (3, "7", None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, t string, m decimal(15,2)")


def test_null_counts(df):
    out = {r.column_name: (r.row_count, r.null_count) for r in profile.null_counts(df, "x").collect()}
    assert out == {"k": (4, 0), "t": (4, 1), "m": (4, 2)}


@pytest.mark.parametrize("approximate", [False, True])
def test_cardinality_counts_null_as_a_value(df, approximate):
    rows = profile.cardinality(df, "x", approximate).collect()
    assert {r.column_name: r.distinct_values for r in rows} == {"k": 3, "t": 3, "m": 3}


def test_cardinality_sees_one_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "d double")
    assert profile.cardinality(df, "x").first().distinct_values == 2


def test_numeric_stats(df):
    out = {r.column_name: r for r in profile.numeric_stats(df, "x").collect()}
    assert (out["k"].value_count, out["k"].mean) == (4, 1.75)
    assert out["k"].stddev == pytest.approx(0.957427107756338)
    assert (out["t"].value_count, out["t"].mean) == (3, 7.0)
    assert (out["t"].min_value, out["t"].max_value) == ("7", "a")
    assert (out["m"].mean, out["m"].min_value) == (1.5, "0.50")


def test_table_info(df):
    assert [tuple(r) for r in profile.table_info(df, "x").collect()] == [
        ("x", 4, 1, "k", "int"),
        ("x", 4, 2, "t", "string"),
        ("x", 4, 3, "m", "decimal(15,2)"),
    ]


def test_partition_counts(spark):
    rows = profile.partition_counts(spark.range(100, numPartitions=5), "x").collect()
    assert len(rows) == 5 and sum(r.row_count for r in rows) == 100


def test_sample_takes_the_first_rows_by_key(df):
    rows = profile.sample_rows(df, "x", ("k",), n=2).collect()
    assert {(r.row_key, r.column_name, r.value) for r in rows} == {
        ("1", "k", "1"), ("1", "t", None), ("1", "m", None), ("1", "t", "a"), ("1", "m", "2.50"),
    }


@pytest.mark.parametrize("approximate", [False, True])
def test_cardinality_of_an_empty_table_is_zero(df, approximate):
    rows = profile.cardinality(df.limit(0), "x", approximate).collect()
    assert {r.column_name: r.distinct_values for r in rows} == {"k": 0, "t": 0, "m": 0}


def test_cardinality_of_every_kind_of_column(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
             (1Y, 2L, 1.5BD, 12345678901234567890123456789012345678BD, 1.5D, DATE'2000-01-01',
              TIMESTAMP'2000-01-01', true, 'a', X'00'),
             (1Y, 3L, 1.25BD, 1BD, -0.0D, DATE'2000-01-02', TIMESTAMP'2000-01-01', false, 'A', X'01'),
             (2Y, 3L, 1.50BD, 1BD, 0.0D, NULL, NULL, NULL, NULL, NULL)
           AS t(a, b, c, d, e, f, g, h, i, j)"""
    )
    rows = profile.cardinality(df, "x").collect()
    found = {r.column_name: r.distinct_values for r in rows}
    assert found == dict(zip("abcdefghij", (2, 2, 2, 2, 2, 3, 2, 3, 3, 3)))


def test_a_sample_is_the_same_for_any_partitioning(spark):
    rows = [(i, "abc"[i % 3], i % 7) for i in range(300)] + [(5, "a", 9), (None, "b", 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "k int, s string, v int")
    samples = {
        frozenset(profile.hash_sample(d, ("k",), 4, ("s",)).collect())
        for d in (df.coalesce(1), df.repartition(7), df.repartition(3, "v"), df.orderBy("v"))
    }
    (one,) = samples
    assert sorted(str(r.s) for r in one) == ["None"] + ["a"] * 4 + ["b"] * 4 + ["c"] * 4
    assert profile.hash_sample(df, ("k",), 6).count() == 6
    assert profile.hash_sample(df.limit(0), ("k",), 6).collect() == []


def test_samples_of_parts_add_up(spark):
    df = spark.range(1_000).selectExpr("id AS k", "id % 4 AS s")
    parts = [profile.hash_sample(df.where(f"k % 3 = {p}"), ("k",), 5, ("s",)) for p in range(3)]
    together = profile.hash_sample(parts[0].union(parts[1]).union(parts[2]), ("k",), 5, ("s",))
    assert set(together.collect()) == set(profile.hash_sample(df, ("k",), 5, ("s",)).collect())


def test_every_task_sends_no_more_than_its_own_sample(spark):
    df = spark.range(1_000, numPartitions=4).selectExpr("id AS k", "id % 2 AS s")
    plan = profile.hash_sample(df, ("k",), 5, ("s",))._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange hashpartitioning")
    assert "WindowGroupLimit" in after and ", 5, Partial" in after
