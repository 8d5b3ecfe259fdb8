"""Run every registered query beside its SQL and compare all values exactly.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, queries
from goldseam.session import build_session

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in RAW_TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def differences(
    spark: SparkSession, connection: duckdb.DuckDBPyConnection, sf_dir: str, name: str
) -> list[str]:
    """What differs between a query and its SQL; empty when they agree in every value."""
    df = queries.registered()[name](spark, sf_dir)
    cursor = connection.execute(oracle.statements()[name])
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    positions = [names.index(c) for c in order]
    theirs = Counter(tuple(_plain(r[i]) for i in positions) for r in cursor.fetchall())
    found = [f"spark only: {r}" for r in list((ours - theirs).elements())[:3]]
    found += [f"sql only:   {r}" for r in list((theirs - ours).elements())[:3]]
    return found and [str(order), f"{ours.total()} rows, {theirs.total()} expected", *found]


def _plain(value):
    if isinstance(value, Decimal):
        raise TypeError("a decimal reached the comparison")
    if isinstance(value, dt.datetime):
        raise TypeError("a timestamp reached the comparison")
    return float(value) if isinstance(value, float) else value


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:]
    spark = build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = oracle.statements()
    failed = 0
    for name in names or sorted(queries.registered()):
        started = time.perf_counter()
        found = differences(spark, connection, sf_dir, name) if name in sql else ["no SQL"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':5}{name:32}{time.perf_counter() - started:7.2f}s")
        for line in found:
            print("     ", line)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
