"""Data-quality rules, every one reported as (table_name, rule, checked, failed)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam import functions as fn


@dataclass(frozen=True)
class Rule:
    """``holds`` is the SQL condition of a good row; NULL counts as not satisfied."""

    name: str
    holds: str


def not_null_rules(columns: Iterable[str]) -> list[Rule]:
    return [Rule(f"not_null:{c}", f"{c} IS NOT NULL") for c in columns]


def accepted_value_rules(accepted: dict[str, tuple[str, ...]]) -> list[Rule]:
    return [
        Rule(f"accepted_values:{c}", f"{c} IN ({', '.join(map(repr, values))})")
        for c, values in accepted.items()
    ]


# The lower bound of each measure, and whether the bound itself is allowed.
LOWER_BOUNDS: dict[str, dict[str, str]] = {
    "part": {"p_retailprice": "> 0"},
    "partsupp": {"ps_availqty": ">= 0", "ps_supplycost": "> 0"},
    "orders": {"o_totalprice": "> 0"},
    "lineitem": {"l_quantity": "> 0"},
}

# Classified columns of each relation and the labels they may hold.
ACCEPTED: dict[str, dict[str, tuple[str, ...]]] = {
    "supplier": {"s_acctbal_status": fn.ACCOUNT_STATUSES},
    "customer": {"c_acctbal_status": fn.ACCOUNT_STATUSES},
    "part": {"p_size_category": fn.SIZE_CATEGORIES},
    "fct_revenue_by_supplier": {"performance_tier": fn.PERFORMANCE_TIERS},
    "fct_inventory": {
        "stock_level": fn.STOCK_LEVELS,
        "cost_category": fn.COST_CATEGORIES,
    },
}


def range_rules(table: str) -> list[Rule]:
    return [
        Rule(f"range:{c} {bound}", f"{c} {bound}")
        for c, bound in LOWER_BOUNDS.get(table, {}).items()
    ]


def check_rows(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """All row-level rules of one relation from one scan."""
    totals = df.selectExpr(
        "count(1) AS checked", *(f"count_if({r.holds}) AS ok{i}" for i, r in enumerate(rules))
    )
    per_rule = ", ".join(f"'{r.name}', checked - ok{i}" for i, r in enumerate(rules))
    return totals.selectExpr(
        f"'{table}' AS table_name",
        "checked",
        f"stack({len(rules)}, {per_rule}) AS (rule, failed)",
    )


@dataclass(frozen=True)
class Reference:
    """``child.column`` should hold a value of ``parent.parent_column`` or NULL."""

    child: str
    column: str
    parent: str
    parent_column: str

    @property
    def rule(self) -> str:
        return f"relationship:{self.column}->{self.parent}.{self.parent_column}"


def check_unique(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Surplus rows per key, for all tables in one shuffle."""
    frames = {table: df for table, (df, _) in tables.items()}
    return check_keys(frames, {table: key for table, (_, key) in tables.items()}, [])


def check_references(frames: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """Rows whose reference finds no parent, for all references in one shuffle and no join."""
    return check_keys(frames, {}, references)


def check_keys(
    frames: dict[str, DataFrame],
    unique: dict[str, tuple[str, ...]],
    references: list[Reference],
) -> DataFrame:
    """Rules on unique keys and on references, from one scan of each relation and one shuffle.

    A relation gives an entry per row and rule it takes part in: its unique key, its references
    and the keys that others refer to.  They meet in one aggregate per (rule, key), which combines
    on the map side, so a key that most rows share arrives as one row per task.  Rules travel as
    numbers; incomplete keys are left to the not-null rules.  A rule is reported with zeros where
    nothing was there to check.
    """
    rules = [(t, "unique:" + ",".join(key)) for t, key in unique.items()]
    rules += [(r.child, r.rule) for r in references]
    width = max([1, *(len(key) for key in unique.values())])
    parts = [f"k{i}" for i in range(width)]
    sides = []
    for name, df in frames.items():
        entries = []
        for number, (table, key) in enumerate(unique.items()):
            if table == name:
                entries.append(_entry(number, df, key, width, "false"))
        for number, r in enumerate(references, start=len(unique)):
            if r.child == name:
                entries.append(_entry(number, df, (r.column,), width, "false"))
            if r.parent == name:
                entries.append(_entry(number, df, (r.parent_column,), width, "true"))
        if entries:
            columns = ", ".join(["rule_no", *parts, "is_parent"])
            sides.append(
                df.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS ({columns})")
            )
    per_key = (
        _union(sides)
        .filter(F.col("k0").isNotNull())
        .groupBy("rule_no", *parts)
        .agg(F.count_if(~F.col("is_parent")).alias("n"), F.max("is_parent").alias("has_parent"))
    )
    surplus = F.when(F.col("rule_no") < len(unique), F.col("n") - 1)
    per_rule = per_key.groupBy("rule_no").agg(
        F.sum("n").alias("checked"),
        F.sum(surplus.when(F.col("has_parent"), 0).otherwise(F.col("n"))).alias("failed"),
    )
    # One row even without input; its map has an entry per rule that checked something.
    found = per_rule.agg(
        F.map_from_entries(
            F.collect_list(F.struct("rule_no", F.struct("checked", "failed")))
        ).alias("found")
    )
    listed = ", ".join(
        f"'{table}', '{rule}', coalesce(found[{i}].checked, 0L), coalesce(found[{i}].failed, 0L)"
        for i, (table, rule) in enumerate(rules)
    )
    return found.selectExpr(
        f"stack({len(rules)}, {listed}) AS (table_name, rule, checked, failed)"
    )


def _entry(number: int, df: DataFrame, key: tuple[str, ...], width: int, is_parent: str) -> str:
    """A row of the stack; an incomplete key has no first part."""
    parts = [_key(df, column) for column in key]
    if len(key) > 1:
        whole = " AND ".join(f"{column} IS NOT NULL" for column in key)
        parts[0] = f"IF({whole}, {parts[0]}, NULL)"
    parts += ["CAST(NULL AS BIGINT)"] * (width - len(parts))
    return ", ".join([str(number), *parts, is_parent])


def _key(df: DataFrame, column: str) -> str:
    """Keys are whole numbers or dates; both compare as whole numbers."""
    is_date = isinstance(df.schema[column].dataType, T.DateType)
    return f"CAST({f'unix_date({column})' if is_date else column} AS BIGINT)"


def score(results: DataFrame) -> DataFrame:
    """One row: the share of checks that passed."""
    return results.agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum("checked").alias("checked"),
        F.sum("failed").alias("failed"),
    ).select("*", (1 - F.try_divide("failed", "checked")).alias("score"))


def reconcile(layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Row counts of each relation in every layer that has it, one column per layer."""
    counts = _union(
        df.selectExpr("count(1) AS n").selectExpr(
            f"'{relation}' AS table_name",
            *(
                f"{'n' if layer == own else 'CAST(NULL AS BIGINT)'} AS {layer}_rows"
                for layer in layers
            ),
        )
        for own, relations in layers.items()
        for relation, df in relations.items()
    )
    return counts.groupBy("table_name").agg(
        *(F.max(f"{layer}_rows").alias(f"{layer}_rows") for layer in layers)
    )


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
