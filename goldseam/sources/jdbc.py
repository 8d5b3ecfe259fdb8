"""Tables of a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.schemas import TABLES, Table
from goldseam.sources.chunks import Counter, Keyed, manifest, predicates


class JdbcSource:
    """Reads small tables whole and large ones as parallel key ranges.

    The database counts keys by ranges of equal width, Spark makes chunks of the counts, and no row
    leaves the table for it.  A JDBC read takes its partitions as a list of predicates, so the
    driver holds one for each chunk.  Every chunk is one connection while its task runs, so the
    running tasks bound the load on the database.
    """

    def __init__(
        self,
        spark: SparkSession,
        url: str,
        properties: dict[str, str] | None = None,
        prefix: str = "",
        fetch_size: int = 10_000,
    ):
        self.spark = spark
        self.url = url
        self.properties = {"fetchsize": str(fetch_size), **(properties or {})}
        self.prefix = prefix

    def read(self, table: str) -> DataFrame:
        spec = TABLES[table]
        name = self.prefix + table
        if spec.whole_extract:
            return self.spark.read.jdbc(self.url, name, properties=self.properties)
        return self.spark.read.jdbc(
            self.url, name, predicates=self._predicates(spec, name), properties=self.properties
        )

    def query(self, sql: str) -> DataFrame:
        """Run a query in the database."""
        return self.spark.read.jdbc(self.url, f"({sql}) q", properties=self.properties)

    def row_count(self, table: str) -> int:
        return int(self.query(f"SELECT COUNT(*) AS n FROM {self.prefix}{table}").first()[0])

    def _predicates(self, spec: Table, name: str) -> list[str]:
        table = Keyed(spec.name, spec.chunk_size, self._counter(name, spec.key[0]))
        chunks = manifest([table]).orderBy("chunk_id").collect()
        return predicates(chunks, spec.key, spec.chunk_size)

    def _counter(self, name: str, key: str) -> Counter:
        """Counts keys in the database, by the first key of their range."""

        def count(level: int, low: int | None, high: int | None) -> DataFrame:
            width = 1 << level
            first = f"{key} - MOD(MOD({key}, {width}) + {width}, {width})"
            where = "1 = 1" if low is None else f"{key} BETWEEN {low} AND {high}"
            counted = self.query(
                f"SELECT first_key, COUNT(*) AS n, MIN(k) AS least, MAX(k) AS most FROM "
                f"(SELECT {first} AS first_key, {key} AS k FROM {name} WHERE {where}) r "
                "GROUP BY first_key"
            )
            return counted.select(
                F.shiftright(F.col("first_key").cast("long"), level).alias("number"),
                *(F.col(c).cast("long").alias(c) for c in ("n", "least", "most")),
            )

        return count
