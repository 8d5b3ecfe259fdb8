import pytest
from pyspark.sql import functions as F

from goldseam.operators import sketches
from goldseam.operators.sketches import DISTINCT_ERROR, PROBABILITIES, RANK_ERROR, SketchStore


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(60_000).selectExpr(
        "id AS key",
        "CAST(id % 7 AS INT) AS small",
        "CAST(pow(id % 5000, 2) AS DECIMAL(15,2)) AS amount",
        "IF(id % 4 = 0, NULL, concat('x', id % 20000)) AS words",
        "date_add(DATE'2000-01-01', CAST(id % 900 AS INT)) AS day",
        "CAST(NULL AS DOUBLE) AS nothing",
    )


def checked(profile, df):
    """Every estimate of a profile against the rows themselves."""
    rows = df.count()
    for r in sketches.distinct_estimates(profile).collect():
        exact = df.select(r.column_name).distinct().count()
        assert abs(r.distinct_values - exact) <= max(1, DISTINCT_ERROR * exact), r
        assert (r.row_count, r.null_count) == (rows, df.where(f"{r.column_name} IS NULL").count())
    found = sketches.quantiles(profile).collect()
    assert {r.column_name for r in found} == {"key", "small", "amount", "day"}
    assert len(found) == 4 * len(PROBABILITIES)
    for r in found:
        number = F.unix_date("day") if r.column_name == "day" else F.col(r.column_name)
        below, upto = df.agg(F.count_if(number < r.quantile), F.count_if(number <= r.quantile)).first()
        assert below / rows - RANK_ERROR <= r.probability <= upto / rows + RANK_ERROR, r


def test_one_part(df):
    checked(sketches.merged(sketches.sketched(df, "t")), df)


def test_one_scan(df):
    plan = sketches.sketched(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1


def test_new_parts_update_the_profile_without_the_old_ones(spark, df, tmp_path):
    store = SketchStore(spark, f"{tmp_path}/sketches")
    for part in range(5):
        rows = df.where(f"key % 5 = {part}")
        rows.write.parquet(f"{tmp_path}/part{part}")
        store.add(spark.read.parquet(f"{tmp_path}/part{part}"), "t", str(part))
    for part in range(5):  # nothing of the rows is left to be read
        for file in (tmp_path / f"part{part}").iterdir():
            file.write_bytes(b"")
    checked(store.profile(), df)
    store.add(df.where("key % 5 = 3"), "t", "3")  # again: the part gives way
    checked(store.profile(), df)
    assert store.read().count() == 5 * len(df.columns)


def test_tables_stay_apart(spark, tmp_path):
    store = SketchStore(spark, f"{tmp_path}/s")
    store.add(spark.range(10), "a", "1")
    store.add(spark.range(500), "b", "1")
    found = {r.table_name: r.distinct_values for r in sketches.distinct_estimates(store.profile()).collect()}
    assert found["a"] == 10 and abs(found["b"] - 500) <= 17


def test_nothing_to_sketch(spark, df):
    profile = sketches.merged(sketches.sketched(df.limit(0), "t"))
    assert {r.distinct_values for r in sketches.distinct_estimates(profile).collect()} == {0}
    assert sketches.quantiles(profile).collect() == []


def test_distinct_keys_are_exact(spark):
    keys = spark.range(100_000).selectExpr("IF(id % 10 = 0, NULL, id * 3 % 70000 - 20000) AS k")
    exact = keys.where("k IS NOT NULL").distinct().count()
    parts = [sketches.key_bitmaps(keys.where(f"pmod(hash(k), 3) = {p}"), "k") for p in range(3)]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[1])
    assert sketches.distinct_keys(whole).first().distinct_values == exact
    assert sketches.distinct_keys(sketches.key_bitmaps(keys.limit(0), "k")).first().distinct_values == 0


def test_sketches_that_nobody_reads_are_not_made(df):
    whole = sketches.merged(sketches.sketched(df, "t"))
    for wanted, other in (("quantile_sketch", "hll"), ("distinct_sketch", "kll")):
        plan = whole.select("column_name", wanted)._jdf.queryExecution().executedPlan().toString()
        assert other not in plan


def test_a_value_is_ranked_once_against_all_quantiles_of_its_column(spark, small):
    """What is counted in the end are places of values, fewer than values or quantiles times values."""
    from checks import queries

    query = queries.registered()["profile_quantile_sketch"](spark, small)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "column_no" in plan and "hll" not in plan
    counted = plan.index("keys=[column_no")
    assert "probability" not in plan[counted:plan.index("FileScan", counted)]
    assert query.where("NOT near").isEmpty()
