"""The batch job: extract to Bronze, clean to Silver, model Gold, load the warehouse."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Collection, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from time import sleep

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.operators import bronze, silver
from goldseam.plans import quality
from goldseam.plans.warehouse import Warehouse, bronze_of
from goldseam.schemas import TABLES
from goldseam.session import build_session, shuffle_partitions_for, sized
from goldseam.sinks.files import with_audit
from goldseam.sinks.warehouse import (
    LOAD_ORDER,
    REPORT_SCHEMA,
    JdbcSink,
    ParquetSink,
    Sink,
    load_all,
)
from goldseam.sources.files import ParquetSource, list_files
from goldseam.sources.jdbc import JdbcSource
from goldseam.versions import (
    Buckets,
    PublishedSource,
    latest,
    point_view,
    publish,
    rows_made_from,
)

log = logging.getLogger(__name__)

STAGES = ("ingest", "model", "all")
LOADED, FAILED = "loaded", "failed"
# Marts of one step need only marts of earlier steps.
GOLD_STEPS = (
    ("dim_date", "dim_customer", "dim_supplier", "dim_part", "fct_sales"),
    ("fct_inventory", "fct_revenue_by_supplier"),
)
# Tables and marts that each mart is built from.
NEEDS = {
    "dim_date": ("orders",),
    "dim_customer": ("customer", "nation", "region"),
    "dim_supplier": ("supplier", "nation", "region"),
    "dim_part": ("part",),
    "fct_sales": ("lineitem", "orders"),
    "fct_inventory": ("partsupp", "dim_part", "dim_supplier"),
    "fct_revenue_by_supplier": ("fct_sales",),
}
# Stored facts are partitioned by the year of a date, which predicates on the year prune.
PARTITIONS = {
    "fct_sales": {"order_year": "order_date"},
    "fct_revenue_by_supplier": {"date_year": "date_key"},
}

# Silver tables stored in buckets of a key; those that are joined on it get equally many.
BUCKET_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


@dataclass(frozen=True)
class Layout:
    """Where the layers of one warehouse are stored."""

    root: str

    def path(self, layer: str, name: str = "") -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}".rstrip("/")


@dataclass(frozen=True)
class Effort:
    """How hard a run tries, and what it may leave as it is.

    A table that fails is tried ``retries`` times more, the first time after ``wait`` seconds and
    each time after twice as many; a plan that can't be made fails at once.  With ``resume`` a
    table whose last version was made from the same inputs is not made again, so that a run after
    a failure does only what is missing.
    """

    retries: int = 0
    wait: float = 1.0
    resume: bool = False

    def publish(self, build: Callable[[], DataFrame], path: str, spark, inputs, **more) -> int:
        """Publish a dataset unless it is there already; its rows."""
        if self.resume:
            rows = rows_made_from(spark, path, inputs)
            if rows is not None:
                return rows
        return publish(build(), path, made_from=inputs, **more)

    def tried(self, one: Callable[[str], int]) -> Callable[[str], int]:
        """One table's work, again if it fails."""

        def again(table: str) -> int:
            wait = self.wait
            for left in range(self.retries, -1, -1):
                try:
                    return one(table)
                except (AnalysisException, StageFailed):
                    raise
                except Exception as error:
                    if not left:
                        raise
                    log.warning("%s failed, again in %s s: %s", table, wait, error)
                    sleep(wait)
                    wait *= 2
            raise AssertionError("unreachable")

        return again


ONCE = Effort()


def extract(
    spark: SparkSession,
    raw: Callable[[str], DataFrame],
    layout: Layout,
    effort: Effort = ONCE,
) -> DataFrame:
    """Write every table to Bronze; report a table that fails, whatever the reason, and go on.

    The tables are independent Spark jobs and are submitted together, so small ones fill the
    gaps the large ones leave.  A failed table keeps the Bronze of an earlier run.
    """
    typed = bronze_of(raw)

    def one(table: str) -> int:
        inputs = _raw_inputs(raw, table) if effort.resume else None
        return effort.publish(lambda: typed(table), layout.path("bronze", table), spark, inputs)

    return _stage(spark, TABLES, effort.tried(one))


def _raw_inputs(raw: Callable[[str], DataFrame], table: str) -> str | None:
    """The files of a raw table as a digest of their names, sizes and times; a database has none."""
    source = getattr(raw, "__self__", None)
    if not isinstance(source, ParquetSource):
        return None
    listed = list_files(source.spark, source.path(table))
    found = listed.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)")).alias("mixed"),
    ).first()
    return f"{found.files} files, {found.mixed}"


def _versions_of(spark: SparkSession, layout: Layout, layer: str, *names: str) -> str:
    """The versions of datasets of a layer that are current now."""
    return ", ".join(f"{name} {latest(spark, layout.path(layer, name)).name}" for name in names)


def transform(
    spark: SparkSession,
    layout: Layout,
    rules: str = "standard",
    failed: Collection[str] = (),
    effort: Effort = ONCE,
) -> DataFrame:
    """Clean every Bronze table into Silver, but for those that failed to be extracted.

    Lines and orders are dealt into as many buckets of their order key, so that they are shuffled
    here once and not by every join of them.
    """
    store = PublishedSource(spark, layout.path("bronze"))
    count = bucket_count(spark, store.input_bytes())

    def one(table: str) -> int:
        if table in failed:
            raise StageFailed(f"{table} was not extracted in this run")
        inputs = f"{_versions_of(spark, layout, 'bronze', table)}, {rules}"
        buckets = Buckets(BUCKET_KEYS[table], count) if table in BUCKET_KEYS else None

        def cleaned() -> DataFrame:
            return silver.clean(bronze.conform(store.read(table), table), table, rules)

        return effort.publish(cleaned, layout.path("silver", table), spark, inputs, buckets=buckets)

    return _stage(spark, TABLES, effort.tried(one))


def bucket_count(spark: SparkSession, input_bytes: int) -> int:
    """Buckets for tables of a size: a power of two, so that counts of different runs still fit."""
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (shuffle_partitions_for(input_bytes, at_least) - 1).bit_length()


def model(
    spark: SparkSession,
    layout: Layout,
    run_at: datetime | None = None,
    failed: Collection[str] = (),
    effort: Effort = ONCE,
) -> DataFrame:
    """Build and store the marts, those of one step together; views ``gold.<mart>`` show them.

    Later marts read the stored earlier ones, so the join of lines and orders is paid once.  A mart
    that needs a failed table or mart fails, and its last good version stays.
    """
    run_at = run_at or datetime.now(UTC).replace(tzinfo=None)
    out, stored, rows = set(failed), set(), []
    for step in GOLD_STEPS:
        warehouse = _Modelling(spark, layout, frozenset(stored))

        def one(name: str) -> int:
            if bad := sorted(out.intersection(NEEDS[name])):
                raise StageFailed(f"{name} needs {', '.join(bad)}")
            split = PARTITIONS.get(name, {})
            marts = [n for n in NEEDS[name] if n in stored]
            tables = [n for n in NEEDS[name] if n not in stored]
            inputs = "; ".join(
                _versions_of(spark, layout, layer, *names)
                for layer, names in (("silver", tables), ("gold", marts))
            )

            def dated() -> DataFrame:
                rows = with_audit(warehouse.mart(name), run_at)
                for column, source in split.items():
                    rows = rows.withColumn(column, F.year(source))
                # files of even size, however many rows a year has
                return rows.hint("rebalance", *split) if split else rows

            path = layout.path("gold", name)
            written = effort.publish(dated, path, spark, inputs, partition_by=tuple(split))
            point_view(spark, f"gold.{name}", layout.path("gold", name))
            return written

        done = _together(_reported(effort.tried(one)), step)
        rows += done
        out.update(name for name, _, status in done if status != LOADED)
        stored.update(step)
    return spark.createDataFrame(rows, REPORT_SCHEMA)


class StageFailed(RuntimeError):
    """A table that can't be built in this run."""


class _Modelling(Warehouse):
    """Silver from storage, and those marts from storage that are already written."""

    def __init__(self, spark: SparkSession, layout: Layout, stored: frozenset[str]):
        super().__init__(silver=PublishedSource(spark, layout.path("silver")).read)
        self._gold_store = PublishedSource(spark, layout.path("gold"))
        self._stored = stored

    def _build(self, name: str) -> DataFrame:
        return self._gold_store.read(name) if name in self._stored else super()._build(name)


def load(
    spark: SparkSession, layout: Layout, sink: Sink, failed: Collection[str] = ()
) -> DataFrame:
    """Load the stored marts in order; those that failed to be built are reported, not loaded."""
    stored = PublishedSource(spark, layout.path("gold"))
    good = {name: stored.read(name) for name in LOAD_ORDER if name not in failed}
    report = load_all(spark, good, sink)
    bad = [(name, None, FAILED) for name in LOAD_ORDER if name in failed]
    return report.unionByName(spark.createDataFrame(bad, REPORT_SCHEMA)) if bad else report


def run(
    spark: SparkSession,
    layout: Layout,
    raw: Callable[[str], DataFrame] | None = None,
    sink: Sink | None = None,
    stage: str = "all",
    effort: Effort = ONCE,
) -> dict[str, DataFrame]:
    """Run one stage or all of them and return their reports.

    What an ingest could not bring up to date is remembered beside the layers, so a later run of
    ``model`` alone builds nothing from it either.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {STAGES}")
    reports = {}
    if stage in ("ingest", "all"):
        if raw is None:
            raise ValueError("ingest needs a source")
        with sized(spark, _raw_bytes(raw)):
            reports["extract"] = extract(spark, raw, layout, effort)
        with sized(spark, PublishedSource(spark, layout.path("bronze")).input_bytes()):
            reports["transform"] = transform(
                spark, layout, failed=not_loaded(reports["extract"]), effort=effort
            )
        publish(reports["transform"].coalesce(1), layout.path("runs", "ingest"))
    if stage in ("model", "all"):
        last = PublishedSource(spark, layout.path("runs")).read("ingest")
        with sized(spark, PublishedSource(spark, layout.path("silver")).input_bytes()):
            reports["model"] = model(spark, layout, failed=not_loaded(last), effort=effort)
            if sink is not None:
                reports["load"] = load(spark, layout, sink, not_loaded(reports["model"]))
    return reports


def not_loaded(report: DataFrame) -> set[str]:
    """The tables of a report that did not get through."""
    return {r.table_name for r in report.filter(F.col("status") != LOADED).collect()}


def _raw_bytes(raw: Callable[[str], DataFrame]) -> int:
    """Size of the raw tables as far as their plans tell it; a database doesn't."""
    source = getattr(raw, "__self__", None)
    return _bytes_below(source.spark, source.root) if isinstance(source, ParquetSource) else 0


def _bytes_below(spark: SparkSession, path: str) -> int:
    try:
        return ParquetSource(spark, path).input_bytes()
    except AnalysisException:  # nothing is stored there
        return 0


def report(spark: SparkSession, work: dict[str, Callable[[], int]]) -> DataFrame:
    """Do each table's work, which gives its rows, and report them and how it went."""
    return _stage(spark, work, lambda table: work[table]())


def _stage(spark: SparkSession, tables: Iterable[str], one: Callable[[str], int]) -> DataFrame:
    return spark.createDataFrame(_together(_reported(one), tables), REPORT_SCHEMA)


def _reported(one: Callable[[str], int]) -> Callable[[str], tuple[str, int | None, str]]:
    """Run one table's work; any failure is logged and becomes its status."""

    def reported(table: str) -> tuple[str, int | None, str]:
        try:
            return table, one(table), LOADED
        except Exception as error:
            log.error("%s failed: %s", table, error)
            return table, None, FAILED

    return reported


def _together(one: Callable[[str], tuple], tables: Iterable[str]) -> list[tuple]:
    names = list(tables)
    if not names:
        return []
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        return list(pool.map(one, names))


def validate(
    spark: SparkSession, layout: Layout, sink: Sink | None = None
) -> dict[str, DataFrame]:
    """Quality rules over the stored layers, their score, and the rows of every layer."""
    warehouse = Warehouse.over_stored(spark, layout.root)
    with sized(spark, PublishedSource(spark, layout.path("silver")).input_bytes()):
        return {
            "quality": quality.results(warehouse),
            "score": quality.score(warehouse),
            "reconcile": quality.reconcile(warehouse, sink),
        }


def main(argv: list[str] | None = None) -> int:
    """0 if every table got through and the score is high enough, else 1."""
    args = _arguments().parse_args(argv)
    spark = build_session("goldseam")
    raw = None
    if args.source_url:
        properties = _properties(args.source_properties)
        raw = JdbcSource(spark, args.source_url, properties, args.source_prefix).read
    elif args.source:
        raw = ParquetSource(spark, args.source, args.pattern).read
    sink = None
    if args.target_url:
        properties = _properties(args.target_properties)
        sink = JdbcSink(spark, args.target_url, properties, connections=args.target_connections)
    elif args.target:
        sink = ParquetSink(spark, args.target)
    layout = Layout(args.root)
    effort = Effort(args.retries, args.wait, args.resume)
    reports = run(spark, layout, raw, sink, args.stage, effort)
    good = not any(not_loaded(report) for report in reports.values())
    if args.validate and good:
        found = validate(spark, layout, sink)
        score = found["score"].first().score
        good = score is not None and score >= args.min_score
        reports |= found
    for name, report in reports.items():
        print(name)
        report.show(1000, truncate=False)
    return 0 if good else 1


def _properties(path: str | None) -> dict[str, str]:
    """Connection properties, such as user and password, one ``key=value`` per line."""
    if path is None:
        return {}
    lines = Path(path).read_text().splitlines()
    return dict(line.split("=", 1) for line in lines if "=" in line and not line.startswith("#"))


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Build the warehouse")
    parser.add_argument("--root", required=True, help="directory of the layers")
    parser.add_argument("--stage", choices=STAGES, default="all")
    parser.add_argument("--source", help="directory of raw Parquet tables")
    parser.add_argument("--pattern", default="{table}", help="path of a table below --source")
    parser.add_argument("--source-url", help="JDBC URL to extract from")
    parser.add_argument("--source-prefix", default="", help="schema prefix of source tables")
    parser.add_argument("--source-properties", help="file of JDBC properties")
    parser.add_argument("--target", help="directory to load Gold into")
    parser.add_argument("--target-url", help="JDBC URL to load Gold into")
    parser.add_argument("--target-properties", help="file of JDBC properties")
    parser.add_argument(
        "--target-connections", type=int, help="most connections to the target at once"
    )
    parser.add_argument("--retries", type=int, default=2, help="further tries of a failed table")
    parser.add_argument("--wait", type=float, default=30, help="seconds before the first of them")
    parser.add_argument(
        "--resume", action="store_true", help="leave tables whose inputs are those of their last run"
    )
    parser.add_argument("--validate", action="store_true", help="run the quality rules at the end")
    parser.add_argument(
        "--min-score", type=float, default=0.99, help="least quality score of a good run"
    )
    return parser


if __name__ == "__main__":
    raise SystemExit(main())
