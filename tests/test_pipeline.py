import pytest
from pyspark.sql import functions as F

from checks import queries, stock
from goldseam.plans import pipeline, quality
from goldseam.plans.warehouse import MARTS, Warehouse, bronze_of
from goldseam.schemas import TABLES
from goldseam.sinks.files import write_batches, write_parquet
from goldseam.sinks.warehouse import LOAD_ORDER, LoadFailed, ParquetSink, load, load_all
from goldseam.sources.files import ParquetSource, list_files
from goldseam.versions import PublishedSource, drafts
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A directory with all eight raw tables."""
    root = tmp_path_factory.mktemp("source")
    raw = stock.reader(spark, SMALL)
    for table in TABLES:
        raw(table).write.parquet(f"{root}/{table}")
    return str(root)


@pytest.fixture(scope="module")
def built(spark, source, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    layout = pipeline.Layout(str(root))
    sink = ParquetSink(spark, f"{root}/serving")
    ingest = pipeline.run(spark, layout, ParquetSource(spark, source).read, stage="ingest")
    rest = pipeline.run(spark, layout, sink=sink, stage="model")
    return layout, sink, {**ingest, **rest}


def report(df):
    return {r.table_name: (r.row_count, r.status) for r in df.collect()}


def test_reports(built):
    _, _, reports = built
    assert set(reports) == {"extract", "transform", "model", "load"}
    assert report(reports["extract"])["lineitem"] == (6000, "loaded")
    assert report(reports["transform"])["orders"] == (1500, "loaded")
    assert report(reports["model"])["fct_sales"] == (6000, "loaded")
    assert [r.table_name for r in reports["load"].collect()] == list(LOAD_ORDER)


def test_stored_marts_equal_lazy_ones(spark, built):
    layout, sink, _ = built
    lazy = queries.open_warehouse(spark, SMALL)
    stored = Warehouse.over_stored(spark, layout.root)
    for name in MARTS:
        mine, theirs = lazy.mart(name), stored.mart(name)
        extra = ["dbt_updated_at", *pipeline.PARTITIONS.get(name, {})]
        assert theirs.columns == [*mine.columns, *extra]
        plain = theirs.drop(*extra)
        assert plain.schema.simpleString() == mine.schema.simpleString()
        assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()
        assert sink.row_count(name) == mine.count()


def test_marts_are_catalog_tables_partitioned_by_year(spark, built):
    layout, _, _ = built
    n = spark.sql(
        "SELECT count(*) AS n FROM gold.fct_sales JOIN gold.dim_date ON order_date = date_key"
    ).first().n
    assert n == 6000
    one = spark.sql("SELECT * FROM gold.fct_sales WHERE order_year = 1996")
    assert "PartitionFilters: [isnotnull(order_year" in one._jdf.queryExecution().executedPlan().toString()
    assert 0 < one.count() < 6000
    assert one.filter("year(order_date) != 1996").isEmpty()
    files = list_files(spark, layout.path("gold", "fct_sales"), ".parquet").count()
    assert files <= 2 * spark.table("gold.fct_sales").select("order_year").distinct().count()


def test_the_sales_fact_is_built_from_storage_without_a_shuffle(spark, built, conf):
    layout, _, _ = built
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    sales = Warehouse(silver=PublishedSource(spark, layout.path("silver")).read).mart("fct_sales")
    plan = sales._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sales.count() == 6000


def test_stored_silver_keeps_further_columns(spark, source, tmp_path):
    def raw(name):
        df = ParquetSource(spark, source).read(name)
        return df.withColumn("Extra_Col", F.lit(7)) if name == "region" else df

    layout = pipeline.Layout(f"{tmp_path}/w")
    pipeline.run(spark, layout, raw, stage="ingest")
    lazy = Warehouse(bronze=bronze_of(raw)).silver("region")
    stored = Warehouse.over_stored(spark, layout.root).silver("region")
    assert "extra_col" in stored.columns and stored.columns == lazy.columns
    assert stored.exceptAll(lazy).isEmpty() and lazy.exceptAll(stored).isEmpty()


def test_one_audit_time_per_run(spark, built):
    layout, _, _ = built
    stored = Warehouse.over_stored(spark, layout.root)
    times = {r[0] for m in MARTS for r in stored.mart(m).select("dbt_updated_at").distinct().collect()}
    assert len(times) == 1


def test_views_answer_sql(spark, built):
    layout, _, _ = built
    Warehouse.over_stored(spark, layout.root).register_views(spark)
    sql = """SELECT count(*) AS n FROM fct_sales f JOIN dim_date d ON f.order_date = d.date_key"""
    assert spark.sql(sql).first().n == 6000
    assert spark.sql("SELECT count(*) AS n FROM stg_orders").first().n == 1500


def bad_value(spark, source, tmp_path):
    df = ParquetSource(spark, source).read("customer")
    return df.withColumn("c_nationkey", F.when(F.col("c_custkey") > 5, "x").otherwise("1"))


def unreadable(spark, source, tmp_path):
    return spark.read.parquet("/nowhere/customer")


def unknown_driver(spark, source, tmp_path):
    return spark.read.jdbc("jdbc:nothing:x", "customer")


def damaged_file(spark, source, tmp_path):
    path = tmp_path / "damaged"
    ParquetSource(spark, source).read("customer").coalesce(1).write.parquet(str(path))
    (file,) = path.glob("part-*.parquet")
    data = bytearray(file.read_bytes())
    data[4 : len(data) // 2] = b"\0" * (len(data) // 2 - 4)
    file.write_bytes(data)
    for checksum in path.glob(".*.crc"):
        checksum.unlink()
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("spoil", [bad_value, unreadable, unknown_driver, damaged_file])
@pytest.mark.parametrize("again", [False, True])
def test_a_failing_table_stops_what_needs_it_and_nothing_else(spark, source, tmp_path, spoil, again):
    good = ParquetSource(spark, source).read
    layout = pipeline.Layout(f"{tmp_path}/w")
    if again:
        pipeline.run(spark, layout, good)
        before = {
            layer: Warehouse.over_stored(spark, layout.root).__getattribute__(layer)(name).collect()
            for layer, name in (("bronze", "customer"), ("silver", "customer"), ("mart", "dim_customer"))
        }

    def raw(name):
        return spoil(spark, source, tmp_path) if name == "customer" else good(name)

    reports = pipeline.run(spark, layout, raw)
    for stage in ("extract", "transform"):
        found = report(reports[stage])
        assert found.pop("customer") == (None, "failed")
        assert {status for _, status in found.values()} == {"loaded"} and len(found) == 7
    marts = report(reports["model"])
    assert marts.pop("dim_customer") == (None, "failed")
    assert {status for _, status in marts.values()} == {"loaded"}
    later = report(pipeline.run(spark, layout, stage="model")["model"])
    assert later["dim_customer"] == (None, "failed")
    if again:  # the last good layers are as they were
        stored = Warehouse.over_stored(spark, layout.root)
        assert sorted(stored.bronze("customer").collect()) == sorted(before["bronze"])
        assert sorted(stored.silver("customer").collect()) == sorted(before["silver"])
        assert sorted(stored.mart("dim_customer").collect()) == sorted(before["mart"])
    for layer in ("bronze", "silver", "gold"):
        for folder in (tmp_path / "w" / layer).iterdir():
            assert drafts(spark, str(folder)) == []


def test_an_interrupted_write_leaves_the_last_dataset(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_parquet(spark.range(5), path)
    bad = spark.range(9).select(F.expr("IF(id > 7, raise_error('stop'), id)").alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_parquet(bad, path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_failed_marts_are_not_loaded(spark, built):
    layout, sink, _ = built
    found = report(pipeline.load(spark, layout, sink, failed={"dim_part"}))
    assert found["dim_part"] == (None, "failed")
    assert found["fct_sales"] == (6000, "loaded")


def test_empty_load_fails(spark, tmp_path):
    with pytest.raises(LoadFailed, match="no rows"):
        load(spark.range(0), "dim_part", ParquetSink(spark, str(tmp_path)))


def test_lost_rows_fail_the_load(spark, tmp_path):
    class Forgetful(ParquetSink):
        def row_count(self, name):
            return super().row_count(name) - 1

    with pytest.raises(LoadFailed, match="wrote 5 rows, found 4"):
        load(spark.range(5), "dim_part", Forgetful(spark, str(tmp_path)))


def test_load_order_and_stop_at_failure(spark):
    class Log:
        written = []

        def write(self, df, name):
            self.written.append(name)
            return df.count()

        def row_count(self, name):
            return 1

    sink = Log()
    gold = {name: spark.range(1) for name in reversed(LOAD_ORDER)}
    gold["fct_sales"] = spark.range(0)
    with pytest.raises(LoadFailed, match="fct_sales"):
        load_all(spark, gold, sink)
    assert sink.written == list(LOAD_ORDER[: LOAD_ORDER.index("fct_sales") + 1])


def test_validation_of_the_stored_layers(spark, built):
    layout, sink, _ = built
    found = pipeline.validate(spark, layout, sink)
    lazy = queries.open_warehouse(spark, SMALL)
    assert found["score"].collect() == quality.score(lazy).collect()
    assert found["quality"].count() == found["score"].first().rules
    rows = {r.table_name: r for r in found["reconcile"].collect()}
    assert rows["lineitem"].warehouse_rows == rows["lineitem"].gold_rows == 6000
    assert rows["orders"].warehouse_rows is None


@pytest.mark.parametrize(
    "more, code", [([], 0), (["--validate", "--min-score", "0.5"], 0), (["--validate", "--min-score", "1.1"], 1)]
)
def test_command_line(spark, source, tmp_path, capsys, monkeypatch, more, code):
    monkeypatch.setattr(pipeline, "build_session", lambda name: spark)
    argv = ["--root", f"{tmp_path}/w", "--source", source, "--target", f"{tmp_path}/serving"]
    assert pipeline.main(argv + more) == code
    shown = capsys.readouterr().out
    stages = ["extract", "transform", "model", "load"]
    stages += ["quality", "score", "reconcile"] if more else []
    assert [line for line in shown.splitlines() if line.isalpha()] == stages


def test_command_line_fails_with_a_missing_table(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(pipeline, "build_session", lambda name: spark)
    argv = ["--root", f"{tmp_path}/w", "--source", SMALL, "--pattern", stock.PATTERN]
    assert pipeline.main(argv) == 1
    shown = capsys.readouterr().out
    assert [line.split("|")[1].strip() for line in shown.splitlines() if "failed" in line] == [
        "partsupp", "partsupp", "fct_inventory",
    ]


def test_a_source_that_is_not_there_fails_every_table(spark, tmp_path):
    layout = pipeline.Layout(f"{tmp_path}/w")
    reports = pipeline.run(spark, layout, ParquetSource(spark, "/nowhere").read)
    assert all(status == "failed" for r in reports.values() for _, status in report(r).values())


def test_unknown_stage(spark, tmp_path):
    with pytest.raises(ValueError, match="everything"):
        pipeline.run(spark, pipeline.Layout(str(tmp_path)), stage="everything")


def test_batches_leave_nothing_behind(spark, tmp_path):
    path = f"{tmp_path}/b"
    assert write_batches(spark.range(100, numPartitions=1), path, 10).count() == 10
    assert write_batches(spark.range(25, numPartitions=1), path, 10).count() == 3
    assert spark.read.parquet(path).count() == 25


def test_writes_count_rows_without_a_second_run(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    df = spark.range(50).mapInPandas(seen, "id bigint")
    assert write_parquet(df, f"{tmp_path}/w") == 50
    assert runs.value == 50
    assert write_parquet(spark.range(0), f"{tmp_path}/e") == 0
    assert write_parquet(spark.range(9).filter(F.lit(False)), f"{tmp_path}/f") == 0


def test_partitioned_write(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    assert write_parquet(df, f"{tmp_path}/p", partition_by=("p",)) == 10
    assert {r.path.split("/")[-2] for r in list_files(spark, f"{tmp_path}/p").collect()} == {
        "p=0",
        "p=1",
    }


class Flaky:
    """A source whose table fails some times before it can be read."""

    def __init__(self, spark, source, failures):
        self.source, self.failures = ParquetSource(spark, source), failures

    def read(self, name):
        if name == "customer" and self.failures:
            self.failures -= 1
            raise OSError("connection lost")
        return self.source.read(name)


@pytest.mark.parametrize("failures, status", [(1, "loaded"), (2, "loaded"), (3, "failed")])
def test_a_failed_table_is_tried_again(spark, source, tmp_path, monkeypatch, failures, status):
    waits = []
    monkeypatch.setattr(pipeline, "sleep", waits.append)
    effort = pipeline.Effort(retries=2, wait=4)
    raw = Flaky(spark, source, failures)
    found = report(pipeline.extract(spark, raw.read, pipeline.Layout(f"{tmp_path}/w"), effort))
    assert found["customer"][1] == status and waits == [4, 8][:failures]


def test_a_plan_that_cannot_be_made_is_not_tried_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "sleep", None)
    raw = ParquetSource(spark, "/nowhere").read
    found = report(pipeline.extract(spark, raw, pipeline.Layout(f"{tmp_path}/w"), pipeline.Effort(2)))
    assert {status for _, status in found.values()} == {"failed"}


def test_a_resumed_run_does_only_what_is_missing(spark, source, tmp_path, monkeypatch):
    layout, effort = pipeline.Layout(f"{tmp_path}/w"), pipeline.Effort(resume=True)
    made = []
    publish = pipeline.publish

    def published(df, path, **more):
        if "/runs/" not in path:
            made.append(path.rpartition("/w/")[2])
        return publish(df, path, **more)

    monkeypatch.setattr(pipeline, "publish", published)
    bad = pipeline.run(spark, layout, Flaky(spark, source, 9).read, effort=effort)
    assert report(bad["model"])["dim_customer"] == (None, "failed")
    first = set(made)
    assert "bronze/customer" not in first and "gold/fct_sales" in first

    made.clear()
    source_again = ParquetSource(spark, source).read
    # A source without files, such as the flaky one, tells no inputs, so its tables are read again.
    done = pipeline.run(spark, layout, source_again, effort=effort)
    assert {r for r in report(done["model"]).values() if r[1] != "loaded"} == set()
    made.clear()
    again = pipeline.run(spark, layout, source_again, effort=effort)
    assert made == [] and report(again["model"]) == report(done["model"])

    changed = f"{tmp_path}/changed"
    for table in TABLES:
        spark.read.parquet(f"{source}/{table}").write.parquet(f"{changed}/{table}")
    made.clear()
    spark.read.parquet(f"{source}/part").limit(100).write.mode("overwrite").parquet(f"{changed}/part")
    later = pipeline.run(spark, layout, ParquetSource(spark, changed).read, effort=effort)
    assert report(later["model"])["dim_part"][0] == 100
    made.clear()
    spark.read.parquet(f"{source}/part").limit(50).write.mode("overwrite").parquet(f"{changed}/part")
    pipeline.run(spark, layout, ParquetSource(spark, changed).read, effort=effort)
    assert set(made) == {"bronze/part", "silver/part", "gold/dim_part", "gold/fct_inventory"}
