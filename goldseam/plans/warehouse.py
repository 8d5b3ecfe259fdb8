"""The three layers as lazily built DataFrames over any source of raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from goldseam.operators import bronze, dimensions, facts, silver, staging
from goldseam.sources.files import ParquetSource
from goldseam.versions import PublishedSource

Reader = Callable[[str], DataFrame]

MARTS = (
    "dim_customer",
    "dim_supplier",
    "dim_part",
    "dim_date",
    "fct_sales",
    "fct_revenue_by_supplier",
    "fct_inventory",
)


def bronze_of(raw: Reader) -> Reader:
    """Typed tables of a raw source."""
    return lambda name: bronze.conform(raw(name), name)


class Warehouse:
    """Bronze, Silver, staging and Gold relations by name.

    ``gold`` reads marts that are already stored; without it a mart is built from Silver, and
    Silver from Bronze, inside one plan.  Each relation is built once per instance, so a plan
    that uses one twice can reuse its shuffle.
    """

    def __init__(
        self,
        bronze: Reader | None = None,
        silver: Reader | None = None,
        gold: Reader | None = None,
    ):
        self._bronze = bronze
        self._silver = silver
        self._gold = gold
        self._built: dict[tuple[str, ...], DataFrame] = {}

    @classmethod
    def over_raw(cls, spark: SparkSession, root: str, pattern: str = "{table}") -> Warehouse:
        return cls(bronze=bronze_of(ParquetSource(spark, root, pattern).read))

    @classmethod
    def over_stored(cls, spark: SparkSession, root: str) -> Warehouse:
        """A warehouse whose layers were written below ``root`` by the pipeline."""
        root = root.rstrip("/")
        return cls(
            bronze=bronze_of(PublishedSource(spark, f"{root}/bronze").read),
            silver=PublishedSource(spark, f"{root}/silver").read,
            gold=PublishedSource(spark, f"{root}/gold").read,
        )

    def bronze(self, table: str) -> DataFrame:
        return self._once(("bronze", table), lambda: self._bronze(table))

    def silver(self, table: str, rules: str = "standard") -> DataFrame:
        if self._silver and rules == "standard":
            return self._once(("silver", table), lambda: self._silver(table))
        return self._once(
            ("silver", table, rules), lambda: silver.clean(self.bronze(table), table, rules)
        )

    def staging(self, table: str) -> DataFrame:
        return self._once(("staging", table), lambda: staging.stage(self.silver(table), table))

    def mart(self, name: str) -> DataFrame:
        if self._gold:
            return self._once(("mart", name), lambda: self._gold(name))
        return self._once(("mart", name), lambda: self._build(name))

    def register_views(self, spark: SparkSession) -> list[str]:
        """Temporary views ``stg_<table>`` and one per mart, for queries in SQL."""
        for table in staging.RENAMES:
            self.staging(table).createOrReplaceTempView(f"stg_{table}")
        for name in MARTS:
            self.mart(name).createOrReplaceTempView(name)
        return [f"stg_{table}" for table in staging.RENAMES] + list(MARTS)

    def _build(self, name: str) -> DataFrame:
        stg, mart = self.staging, self.mart
        if name == "dim_customer":
            return dimensions.dim_customer(stg("customer"), stg("nation"), stg("region"))
        if name == "dim_supplier":
            return dimensions.dim_supplier(stg("supplier"), stg("nation"), stg("region"))
        if name == "dim_part":
            return dimensions.dim_part(stg("part"))
        if name == "dim_date":
            return dimensions.dim_date(stg("orders"))
        if name == "fct_sales":
            return facts.fct_sales(stg("lineitem"), stg("orders"))
        if name == "fct_revenue_by_supplier":
            return facts.fct_revenue_by_supplier(mart("fct_sales"))
        if name == "fct_inventory":
            return facts.fct_inventory(stg("partsupp"), mart("dim_part"), mart("dim_supplier"))
        raise KeyError(f"unknown mart {name!r}, expected one of {MARTS}")

    def _once(self, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]
