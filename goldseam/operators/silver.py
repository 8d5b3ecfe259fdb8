"""Silver: trimmed text, derived columns and row filters, one rule set per table."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam import functions as fn

RULE_SETS = ("standard", "strict")


@dataclass(frozen=True)
class Cleaning:
    """``keep`` applies under both rule sets, ``keep_strict`` under ``strict`` only."""

    trim: tuple[str, ...] = ()
    derive: dict[str, Callable[[], Column]] = field(default_factory=dict)
    keep: Callable[[], Column] | None = None
    keep_strict: Callable[[], Column] | None = None


CLEANING: dict[str, Cleaning] = {
    "region": Cleaning(
        trim=("r_name",),
        derive={"r_name_clean": lambda: fn.strip_whitespace(F.col("r_name"))},
    ),
    "nation": Cleaning(trim=("n_name", "n_comment")),
    "supplier": Cleaning(
        trim=("s_name", "s_address", "s_phone", "s_comment"),
        derive={"s_acctbal_status": lambda: fn.account_status(F.col("s_acctbal"))},
    ),
    "customer": Cleaning(
        trim=("c_name", "c_address", "c_phone", "c_mktsegment", "c_comment"),
        derive={"c_acctbal_status": lambda: fn.account_status(F.col("c_acctbal"))},
    ),
    "part": Cleaning(
        trim=("p_name", "p_mfgr", "p_brand", "p_type", "p_container", "p_comment"),
        derive={"p_size_category": lambda: fn.size_category(F.col("p_size"))},
        keep_strict=lambda: F.col("p_retailprice") > 0,
    ),
    "partsupp": Cleaning(
        trim=("ps_comment",),
        keep_strict=lambda: (F.col("ps_availqty") >= 0) & (F.col("ps_supplycost") > 0),
    ),
    "orders": Cleaning(
        trim=("o_orderstatus", "o_orderpriority", "o_clerk", "o_comment"),
        derive={
            "o_year": lambda: F.year("o_orderdate"),
            "o_quarter": lambda: F.quarter("o_orderdate"),
        },
        keep=lambda: F.col("o_totalprice") > 0,
    ),
    "lineitem": Cleaning(
        trim=("l_returnflag", "l_linestatus", "l_shipinstruct", "l_shipmode", "l_comment"),
        derive={
            "l_discount_percentage": lambda: F.col("l_discount") * 100,
            "l_net_price": lambda: fn.net_price(F.col("l_extendedprice"), F.col("l_discount")),
            "l_ship_year": lambda: F.year("l_shipdate"),
        },
        keep_strict=lambda: F.col("l_quantity") > 0,
    ),
}


def row_filter(table: str, rules: str = "standard") -> Column | None:
    """Rows Silver keeps, or None when it keeps all; a NULL outcome drops the row."""
    if rules not in RULE_SETS:
        raise ValueError(f"unknown rule set {rules!r}, expected one of {RULE_SETS}")
    cleaning = CLEANING[table]
    chosen = [cleaning.keep, cleaning.keep_strict if rules == "strict" else None]
    conditions = [keep() for keep in chosen if keep]
    return reduce(operator.and_, conditions) if conditions else None


def clean(bronze: DataFrame, table: str, rules: str = "standard") -> DataFrame:
    """Bronze to Silver as one filter and one projection."""
    cleaning = CLEANING[table]
    keep = row_filter(table, rules)
    kept = bronze if keep is None else bronze.filter(keep)
    trimmed = {c: F.trim(F.col(c)) for c in cleaning.trim}
    derived = {name: make() for name, make in cleaning.derive.items()}
    return kept.withColumns(trimmed | derived)


def row_delta(bronze: DataFrame, table: str) -> DataFrame:
    """Rows before cleaning and after it under each rule set, from one scan."""

    def kept(rules: str) -> Column:
        keep = row_filter(table, rules)
        return F.count(F.lit(1)) if keep is None else F.count_if(keep)

    return bronze.agg(
        F.count(F.lit(1)).alias("bronze_rows"),
        kept("standard").alias("standard_rows"),
        kept("strict").alias("strict_rows"),
    ).select(F.lit(table).alias("table_name"), "*")
