"""The data-quality rules of the whole warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from goldseam.operators import quality as q
from goldseam.plans.warehouse import Warehouse
from goldseam.schemas import TABLES
from goldseam.sinks.warehouse import Sink

# Grain of each fact.
FACT_KEYS = {
    "fct_sales": ("order_key", "line_number"),
    "fct_inventory": ("part_key", "supplier_key"),
    "fct_revenue_by_supplier": ("supplier_key", "date_key"),
}

REFERENCES = [
    q.Reference(t.name, column, parent, TABLES[parent].key[0])
    for t in TABLES.values()
    for column, parent in t.foreign_keys.items()
] + [
    q.Reference("fct_sales", "order_date", "dim_date", "date_key"),
    q.Reference("fct_sales", "ship_date", "dim_date", "date_key"),
]


def not_null(warehouse: Warehouse) -> DataFrame:
    """Key columns, as delivered."""
    return _union(
        q.check_rows(warehouse.bronze(t.name), t.name, q.not_null_rules(t.key))
        for t in TABLES.values()
    )


def ranges(warehouse: Warehouse) -> DataFrame:
    """Measures, as delivered."""
    return _union(
        q.check_rows(warehouse.bronze(name), name, q.range_rules(name)) for name in q.LOWER_BOUNDS
    )


def accepted_values(warehouse: Warehouse) -> DataFrame:
    """Classifications, as Silver and Gold give them."""
    return _union(
        q.check_rows(_relation(warehouse, name), name, q.accepted_value_rules(columns))
        for name, columns in q.ACCEPTED.items()
    )


def unique(warehouse: Warehouse) -> DataFrame:
    keys = _unique_keys()
    return q.check_unique({name: (_relation(warehouse, name), key) for name, key in keys.items()})


def relationships(warehouse: Warehouse) -> DataFrame:
    names = dict.fromkeys(n for r in REFERENCES for n in (r.child, r.parent))
    return q.check_references({n: _relation(warehouse, n) for n in names}, REFERENCES)


def keys(warehouse: Warehouse) -> DataFrame:
    """Unique keys and references together: every relation is scanned once."""
    unique_keys = _unique_keys()
    names = dict.fromkeys([*unique_keys, *(n for r in REFERENCES for n in (r.child, r.parent))])
    return q.check_keys({n: _relation(warehouse, n) for n in names}, unique_keys, REFERENCES)


def _unique_keys() -> dict[str, tuple[str, ...]]:
    return {t.name: t.key for t in TABLES.values()} | FACT_KEYS


# The Gold relation with a row per row of a table.
GOLD_OF = {
    "customer": "dim_customer",
    "supplier": "dim_supplier",
    "part": "dim_part",
    "lineitem": "fct_sales",
    "partsupp": "fct_inventory",
}


def reconcile(warehouse: Warehouse, sink: Sink | None = None) -> DataFrame:
    """Rows of each table in Bronze and Silver, of the Gold relation made from it, and, given the
    sink that was loaded, of that relation there."""
    counted = q.reconcile(
        {
            "bronze": {t: warehouse.bronze(t) for t in TABLES},
            "silver": {t: warehouse.silver(t) for t in TABLES},
            "gold": {t: warehouse.mart(m) for t, m in GOLD_OF.items()},
        }
    )
    if sink is None:
        return counted
    loaded = "".join(f" WHEN '{t}' THEN {sink.row_count(m)}L" for t, m in GOLD_OF.items())
    return counted.selectExpr("*", f"CASE table_name{loaded} END AS warehouse_rows")


def results(warehouse: Warehouse) -> DataFrame:
    """Every rule of every family.

    Not-null and range rules of a table share a scan, and so do all its key rules.
    """
    delivered = [
        q.check_rows(
            warehouse.bronze(t.name),
            t.name,
            q.not_null_rules(t.key) + q.range_rules(t.name),
        )
        for t in TABLES.values()
    ]
    return _union([*delivered, accepted_values(warehouse), keys(warehouse)])


def score(warehouse: Warehouse) -> DataFrame:
    """Share of passed checks over all rule families."""
    return q.score(results(warehouse))


def _relation(warehouse: Warehouse, name: str) -> DataFrame:
    return warehouse.silver(name) if name in TABLES else warehouse.mart(name)


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
