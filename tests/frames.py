"""Tiny Bronze tables; columns not given are NULL."""

import datetime as dt
from decimal import Decimal

from goldseam.schemas import TABLES
from goldseam.operators import silver, staging


def day(text):
    return dt.date.fromisoformat(text)


def money(value):
    return None if value is None else Decimal(str(value))


def bronze(spark, table, rows):
    schema = TABLES[table].schema
    decimals = set(TABLES[table].measures)
    values = [
        tuple(
            money(r.get(c)) if c in decimals else r.get(c) for c in schema.fieldNames()
        )
        for r in rows
    ]
    return spark.createDataFrame(values, schema)


def clean(spark, table, rows, rules="standard"):
    return silver.clean(bronze(spark, table, rows), table, rules)


def staged(spark, table, rows):
    return staging.stage(clean(spark, table, rows), table)


def order(key, **values):
    return {
        "o_orderkey": key,
        "o_custkey": 1,
        "o_totalprice": 10,
        "o_orderdate": day("1998-01-05"),
    } | values


def line(order_key, **values):
    return {
        "l_orderkey": order_key,
        "l_linenumber": 1,
        "l_partkey": 1,
        "l_suppkey": 1,
        "l_quantity": 1,
        "l_extendedprice": 100,
        "l_discount": 0,
        "l_tax": 0,
    } | values
