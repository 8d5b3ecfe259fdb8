"""Registry of the eight source tables: columns, types, keys and extract chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = "decimal(15,2)"


@dataclass(frozen=True)
class Table:
    """One source table.

    ``columns`` maps lower-case names to Spark type names in storage order.
    ``measures`` go through double on their way to ``MONEY``.
    ``foreign_keys`` maps a column to the table whose first key column it points at.
    """

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    size: str
    chunk_size: int
    foreign_keys: dict[str, str] = field(default_factory=dict)

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(c for c, t in self.columns.items() if t == MONEY)

    @property
    def whole_extract(self) -> bool:
        """Tables this small are read in one piece."""
        return self.size in ("tiny", "small")

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in self.columns.items()))


# Column names, types, keys, size classes and chunk sizes of the sources.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "region",
            {"r_regionkey": "bigint", "r_name": "string", "r_comment": "string"},
            key=("r_regionkey",),
            size="tiny",
            chunk_size=1000,
        ),
        Table(
            "nation",
            {
                "n_nationkey": "bigint",
                "n_name": "string",
                "n_regionkey": "bigint",
                "n_comment": "string",
            },
            key=("n_nationkey",),
            size="tiny",
            chunk_size=1000,
            foreign_keys={"n_regionkey": "region"},
        ),
        Table(
            "supplier",
            {
                "s_suppkey": "bigint",
                "s_name": "string",
                "s_address": "string",
                "s_nationkey": "bigint",
                "s_phone": "string",
                "s_acctbal": MONEY,
                "s_comment": "string",
            },
            key=("s_suppkey",),
            size="small",
            chunk_size=50_000,
            foreign_keys={"s_nationkey": "nation"},
        ),
        Table(
            "customer",
            {
                "c_custkey": "bigint",
                "c_name": "string",
                "c_address": "string",
                "c_nationkey": "bigint",
                "c_phone": "string",
                "c_acctbal": MONEY,
                "c_mktsegment": "string",
                "c_comment": "string",
            },
            key=("c_custkey",),
            size="medium",
            chunk_size=100_000,
            foreign_keys={"c_nationkey": "nation"},
        ),
        Table(
            "part",
            {
                "p_partkey": "bigint",
                "p_name": "string",
                "p_mfgr": "string",
                "p_brand": "string",
                "p_type": "string",
                "p_size": "int",
                "p_container": "string",
                "p_retailprice": MONEY,
                "p_comment": "string",
            },
            key=("p_partkey",),
            size="medium",
            chunk_size=100_000,
        ),
        Table(
            "partsupp",
            {
                "ps_partkey": "bigint",
                "ps_suppkey": "bigint",
                "ps_availqty": MONEY,
                "ps_supplycost": MONEY,
                "ps_comment": "string",
            },
            key=("ps_partkey", "ps_suppkey"),
            size="large",
            chunk_size=200_000,
            foreign_keys={"ps_partkey": "part", "ps_suppkey": "supplier"},
        ),
        Table(
            "orders",
            {
                "o_orderkey": "bigint",
                "o_custkey": "bigint",
                "o_orderstatus": "string",
                "o_totalprice": MONEY,
                "o_orderdate": "date",
                "o_orderpriority": "string",
                "o_clerk": "string",
                "o_shippriority": "int",
                "o_comment": "string",
            },
            key=("o_orderkey",),
            size="large",
            chunk_size=300_000,
            foreign_keys={"o_custkey": "customer"},
        ),
        Table(
            "lineitem",
            {
                "l_orderkey": "bigint",
                "l_partkey": "bigint",
                "l_suppkey": "bigint",
                "l_linenumber": "bigint",
                "l_quantity": MONEY,
                "l_extendedprice": MONEY,
                "l_discount": MONEY,
                "l_tax": MONEY,
                "l_returnflag": "string",
                "l_linestatus": "string",
                "l_shipdate": "date",
                "l_commitdate": "date",
                "l_receiptdate": "date",
                "l_shipinstruct": "string",
                "l_shipmode": "string",
                "l_comment": "string",
            },
            key=("l_orderkey", "l_linenumber"),
            size="huge",
            chunk_size=500_000,
            foreign_keys={"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
        ),
    )
}
