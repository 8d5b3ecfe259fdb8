"""Readers of published datasets, while and after they are written."""

import pytest
from pyspark.sql import functions as F

from goldseam import versions
from goldseam.versions import PublishedSource, publish, read


def count(spark, path):
    return read(spark, path).count()


def test_versions_replace_one_another(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (5, 3, 0, 9):
        assert publish(spark.range(n), path) == n
        assert count(spark, path) == n
    assert [r.row_count for r in versions.log_records(spark, path).orderBy("number").collect()] == [5, 3, 0, 9]
    assert len(list((tmp_path / "t" / "versions").iterdir())) == versions.KEEP
    assert versions.drafts(spark, path) == []


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing was published"):
        read(spark, f"{tmp_path}/t")
    assert versions.drafts(spark, f"{tmp_path}/t") == []


STEPS = ("write_version", "record", "clean", "_delete")


@pytest.mark.parametrize("before", [True, False])
@pytest.mark.parametrize("step", STEPS)
def test_a_write_interrupted_between_any_two_steps(spark, tmp_path, monkeypatch, step, before):
    """Whatever stops a write, and wherever, readers see the old rows or the new ones, all of them."""
    path = f"{tmp_path}/t"
    publish(spark.range(5), path)
    publish(spark.range(6), path)
    whole = getattr(versions, step)

    def stopped(*args, **more):
        if not before:
            whole(*args, **more)
        raise KeyboardInterrupt

    reader = read(spark, path)
    with monkeypatch.context() as m:
        m.setattr(versions, step, stopped)
        with pytest.raises(KeyboardInterrupt):
            publish(spark.range(7), path)
    published = step in ("clean", "_delete") or (step == "record" and not before)
    assert count(spark, path) == (7 if published else 6)
    assert reader.count() == 6
    left = versions.drafts(spark, path)
    assert len(left) == (0 if published or (step == "write_version" and before) else 1)
    versions.drop_drafts(spark, path, left)
    assert publish(spark.range(8), path) == 8
    assert count(spark, path) == 8 and versions.drafts(spark, path) == []
    assert len(list((tmp_path / "t" / "versions").iterdir())) == versions.KEEP


def test_a_reader_sees_one_version_while_tasks_write(spark, tmp_path):
    """The new rows are read by the plan that replaces them, up to the last task."""
    path = f"{tmp_path}/t"
    publish(spark.range(100), path)
    seen = read(spark, path)
    for turn in range(1, 4):
        grown = seen.union(spark.range(turn))
        assert publish(grown, path) == 100 + sum(range(turn + 1))
        assert seen.count() == 100 + sum(range(turn))
        seen = read(spark, path)


def test_a_failing_write_is_no_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    publish(spark.range(5), path)
    bad = spark.range(9).select(F.expr("IF(id > 7, raise_error('stop'), id)").alias("id"))
    with pytest.raises(Exception, match="stop"):
        publish(bad, path)
    assert count(spark, path) == 5 and versions.drafts(spark, path) == []


def test_two_writers_with_one_number(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    publish(spark.range(1), path)
    first = versions.latest(spark, path)
    monkeypatch.setattr(versions, "latest", lambda *_: first)
    publish(spark.range(2), path, keep=9)
    publish(spark.range(3), path, keep=9)
    monkeypatch.undo()
    records = versions.log_records(spark, path).where("number = 2").collect()
    assert len(records) == 2
    assert count(spark, path) == max(records, key=lambda r: r.name).row_count


def test_a_view_follows_the_current_version(spark, tmp_path):
    path, name = f"{tmp_path}/facts", "gold.published_facts"
    spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (x INT) USING parquet")
    rows = spark.range(10).withColumn("p", F.col("id") % 2)
    publish(rows, path, ("p",))
    versions.point_view(spark, name, path)
    assert spark.table(name).count() == 10
    one = spark.sql(f"SELECT id FROM {name} WHERE p = 1")
    assert one.count() == 5
    assert "PartitionFilters: [isnotnull(p" in one._jdf.queryExecution().executedPlan().toString()
    publish(spark.range(4).withColumn("other", F.lit("x")), path)
    assert spark.table(name).count() == 10  # until it is pointed at the new version
    versions.point_view(spark, name, path)
    assert spark.table(name).columns == ["id", "other"] and spark.table(name).count() == 4


def test_source_of_published_datasets(spark, tmp_path):
    publish(spark.range(5), f"{tmp_path}/a")
    publish(spark.range(6), f"{tmp_path}/a")
    publish(spark.range(7), f"{tmp_path}/b")
    (tmp_path / "empty").mkdir()
    source = PublishedSource(spark, str(tmp_path))
    assert source.read("a").count() == 6
    sizes = [
        f.stat().st_size
        for name in "ab"
        for f in tmp_path.joinpath(name, "versions", versions.latest(spark, f"{tmp_path}/{name}").name).iterdir()
        if not f.name.startswith(".")
    ]
    assert source.input_bytes() == sum(sizes) > 0
    assert PublishedSource(spark, f"{tmp_path}/nowhere").input_bytes() == 0


def bucketed(spark, path, n=1_000, count=4):
    rows = spark.range(n).selectExpr("id % 100 AS k", "id AS v")
    return publish(rows, path, buckets=versions.Buckets("k", count))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_versions_join_without_a_shuffle(spark, tmp_path, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    for name in "ab":
        assert bucketed(spark, f"{tmp_path}/{name}") == 1_000
        assert len([f for f in versions._names_below(spark, versions.current_path(spark, f"{tmp_path}/{name}"))
                    if f.startswith("part-")]) == 4
    source = PublishedSource(spark, str(tmp_path))
    joined = source.read("a").join(source.read("b").withColumnRenamed("v", "w"), "k")
    assert exchanges(joined) == 0 and joined.count() == 100 * 10 * 10
    assert exchanges(source.read("a").groupBy("k").count()) == 0


def test_a_catalog_that_does_not_know_a_bucketed_version(spark, tmp_path):
    bucketed(spark, f"{tmp_path}/a")
    spark.sql(f"DROP DATABASE {versions.BUCKETED} CASCADE")
    found = read(spark, f"{tmp_path}/a")
    assert found.count() == 1_000 and exchanges(found.groupBy("k").count()) == 0


def test_old_bucketed_versions_leave_the_catalog(spark, tmp_path):
    for n in (10, 20, 30, 40):
        assert bucketed(spark, f"{tmp_path}/a", n) == n
    names = {r.name for r in versions.log_records(spark, f"{tmp_path}/a").orderBy("number").collect()}
    known = [n for n in names if spark.catalog.tableExists(versions._table_of(n))]
    assert len(names) == 4 and len(known) == versions.KEEP
    assert count(spark, f"{tmp_path}/a") == 40


def test_a_hot_key_is_published_without_buckets(spark, tmp_path):
    path = f"{tmp_path}/hot"
    rows = spark.range(400_000).selectExpr("IF(id % 10 = 0, id, 7) AS k", "uuid() AS v")
    assert publish(rows, path, buckets=versions.Buckets("k", 16)) == 400_000
    assert versions.latest(spark, path).buckets is None
    assert count(spark, path) == 400_000


def test_a_failing_bucketed_write_leaves_no_table(spark, tmp_path):
    bad = spark.range(9).select(F.expr("IF(id > 7, raise_error('stop'), id)").alias("k"))
    before = len(spark.catalog.listTables(versions.BUCKETED)) if spark.catalog.databaseExists(versions.BUCKETED) else 0
    with pytest.raises(Exception, match="stop"):
        publish(bad, f"{tmp_path}/t", buckets=versions.Buckets("k", 2))
    assert len(spark.catalog.listTables(versions.BUCKETED)) == before
    assert versions.drafts(spark, f"{tmp_path}/t") == []
