"""Seconds per query, warm, median of three; prints one JSON line.

``queries`` holds the registered queries, computed from the raw tables each time.  Entries
starting with ``stored.`` answer the dashboard questions from the stored star schema, which is
how a warehouse user meets them; ``stored.build`` is the time to build all layers.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

from checks import queries as registry, stock
from goldseam.operators import dashboards
from goldseam.plans import pipeline
from goldseam.plans.warehouse import Warehouse
from goldseam.session import build_session

RUNS = 3

HEADLINE = (
    "fct_revenue_by_supplier",
    "fct_sales",
    "fct_inventory",
    "dim_customer",
    "dim_supplier",
    "dim_part",
    "dim_date",
    "silver_lineitem",
    "silver_orders",
    "bronze_conform_lineitem",
    "stg_lineitem",
    "src_chunk_manifest",
    "profile_row_counts",
    "profile_null_counts",
    "profile_cardinality",
    "profile_numeric_stats",
    "dq_not_null",
    "dq_unique",
    "dq_relationships",
    "dq_score",
    "dash_executive",
    "dash_revenue_by_product",
    "dash_top_customers",
    "dash_revenue_trend",
    "dash_inventory",
    "dash_supplier_performance",
    "dash_ship_lag",
)


def timed(action: Callable[[], object]) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def consume(df) -> None:
    """Compute every row and column without collecting or storing them."""
    df.write.format("noop").mode("overwrite").save()


def median(action: Callable[[], object]) -> float:
    action()
    return round(statistics.median(timed(action) for _ in range(RUNS)), 3)


def stored_questions(warehouse: Warehouse) -> dict[str, Callable[[], object]]:
    mart = warehouse.mart
    return {
        "executive": lambda: dashboards.executive_overview(mart("fct_sales")),
        "revenue_by_product": lambda: dashboards.revenue_by_product(
            mart("fct_sales"), mart("dim_part")
        ),
        "top_customers": lambda: dashboards.top_customers(
            mart("fct_sales"), mart("dim_customer")
        ),
        "revenue_trend": lambda: dashboards.revenue_trend(mart("fct_sales"), mart("dim_date")),
        "inventory": lambda: dashboards.inventory_overview(mart("fct_inventory")),
        "supplier_performance": lambda: dashboards.supplier_performance(
            mart("fct_revenue_by_supplier"), mart("dim_supplier")
        ),
        "delivery_times": lambda: dashboards.delivery_times(mart("fct_sales")),
        "ship_lag": lambda: dashboards.ship_lag(mart("fct_sales")),
    }


def bench_root(spark) -> str:
    """Where the layers are stored: $BENCH_ROOT, or a new folder below the shared one.

    Only a run on this machine alone may do without either.
    """
    shared = os.environ.get("BENCH_ROOT") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise SystemExit("set BENCH_ROOT to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/bench-{uuid.uuid4().hex}"


def scale_of(sf_dir: str) -> float | str:
    name = sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries = registry.registered()
    seconds = {
        name: median(lambda name=name: consume(queries[name](spark, sf_dir))) for name in chosen
    }
    if not sys.argv[1:]:
        root = bench_root(spark)
        layout = pipeline.Layout(root)
        raw = stock.reader(spark, sf_dir)
        seconds["stored.build"] = round(timed(lambda: pipeline.run(spark, layout, raw)), 3)
        stored = Warehouse.over_stored(spark, root)
        for name, build in stored_questions(stored).items():
            seconds[f"stored.{name}"] = median(lambda build=build: consume(build()))
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale_of(sf_dir),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
