"""Nearest neighbours by cross-polytope hashing.

A vector's direction is turned by pseudo-random rotations, three rounds of random signs and a fast
Hadamard transform, and hashed to the signed axis nearest to it.  ``TABLES`` rotations give as many
tables, in which every vector is entered once; a query looks into its ``PROBES`` nearest axes of
each.  The vectors found are ranked by their exact distance.  The distance is taken where they are
found, in the tasks that hold a bucket, and only the best of each bucket are kept, so candidate
pairs never travel.  Buckets are cut into blocks of bounded size: a bucket that holds a third of
all vectors is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from goldseam.llm.common import stored

NEAREST = 10
TABLES = 16
PROBES = 6
BLOCK = 8_192  # vectors of a bucket that one group holds, on average
QUERIES = 4_096  # the same for queries
SEED = 20_240

_ALL = -1  # the table in which a query looks at every vector


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, whose length is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        halves = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack(
            [halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2
        ).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotated(units: np.ndarray, table: int) -> np.ndarray:
    """The unit vectors in the pseudo-random rotation of a table."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    turned = np.zeros((len(units), width))
    turned[:, : units.shape[1]] = units
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for sign in signs:
        turned = hadamard(turned * sign)
    return turned


def axes(units: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each vector, nearest first; axis i backwards is i + width."""
    turned = rotated(units, table)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _valid(column: Column) -> Column:
    finite = F.forall(
        column,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return column.isNotNull() & finite & F.exists(column, lambda x: x != 0)


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """The rows that take part: vec_id and vector, as floats if it is stored so, else as doubles."""
    stored_as = table.schema[embedding].dataType.simpleString()
    kind = "array<float>" if stored_as == "array<float>" else "array<double>"
    return table.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vector")
    ).where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))


def hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row per vector, table and probe: width, table, bucket, vec_id, vector."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            lists = batch.column("vector")
            widths = np.diff(lists.offsets.to_numpy())
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                own = lists.take(pa.array(rows))
                values = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                values = values.astype(np.float64)
                scaled = values / np.abs(values).max(axis=1, keepdims=True)
                units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                for table in range(tables):
                    found = axes(units, table, probes)
                    again = pa.array(np.repeat(rows, found.shape[1]))
                    n = len(again)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, table, np.int32)),
                         pa.array(found.reshape(-1).astype(np.int32)), ids.take(again),
                         lists.take(again)],
                        names=["width", "table", "bucket", "vec_id", "vector"],
                    )

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(
        enter, f"width int, table int, bucket int, vec_id long, vector {kind}"
    )


def nearest_of_blocks(index: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """The nearest vectors of each query in each of its buckets: query_id, vec_id, score."""
    bucket = ["width", "table", "bucket"]
    sizes = (
        index.groupBy(*bucket)
        .agg(F.count("*").alias("n"))
        .join(queries.groupBy(*bucket).agg(F.count("*").alias("m")), bucket)
        .select(
            *bucket,
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.ceil(F.col("m") / QUERIES).cast("int").alias("parts"),
        )
    )
    sizes = stored(sizes, "buckets")
    # Each vector goes to one block and every part of the queries, each query the other way round.
    held = index.join(sizes, bucket).select(
        *bucket, "vec_id", "vector",
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.expr("sequence(0, parts - 1)")).alias("part"),
    )
    asked = queries.join(sizes, bucket).select(
        *bucket, "vec_id", "vector",
        F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
    )
    keys = [*bucket, "block", "part"]

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids = held["vec_id"].to_numpy()
            single = held["vec_id"].is_unique
            matrix = np.stack(held["vector"].to_numpy()).astype(np.float64)
            for query, vector in zip(asked["vec_id"], asked["vector"], strict=True):
                score = distances(matrix, np.asarray(vector, np.float64))
                chosen = np.flatnonzero(ids != query)
                if single and nearest < len(chosen):
                    limit = np.partition(score[chosen], nearest - 1)[nearest - 1]
                    chosen = chosen[score[chosen] <= limit]
                chosen = chosen[np.lexsort((ids[chosen], score[chosen]))]
                if not single:
                    chosen = chosen[np.sort(np.unique(ids[chosen], return_index=True)[1])]
                chosen = chosen[:nearest]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[chosen], "score": score[chosen]}))
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(out) if out else none

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
        rank, "query_id long, vec_id long, score double"
    )


def distances(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances of a vector to the rows of a matrix.

    Where a square is too large for a double, the differences are scaled first.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        away = matrix - vector
        found = np.sqrt(np.einsum("ij,ij->i", away, away))
        large = np.flatnonzero(~np.isfinite(found))
        if len(large):
            scale = np.maximum(np.abs(matrix[large]).max(axis=1), np.abs(vector).max())[:, None]
            away = matrix[large] / scale - vector / scale
            found[large] = scale[:, 0] * np.sqrt(np.einsum("ij,ij->i", away, away))
    return found


def _best(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_neighbours(
    table: DataFrame,
    queries: Column | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    nearest: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """For each query its nearest other vectors: query_id, rank from 1, vec_id, score.

    Queries are the rows for which ``queries`` holds, a condition on ``vec_id`` (default: it is
    divisible by 100).  ``score`` is the Euclidean distance of the vectors as given, in double
    precision; ties go to the smaller vec_id.  Rows with a null vec_id, and vectors that are null,
    empty, zero or hold null or non-finite numbers, take no part; vectors of different lengths
    never meet.  Rows with the vec_id of the query are not among its neighbours, and a repeated
    vec_id counts once, with its smallest distance.  A query for which the tables give fewer than
    ``nearest`` is compared with all vectors, in blocks.  A distance beyond the largest double is
    infinite, and such vectors come last.  An empty table gives no rows.
    """
    rows = vectors(table, vec_id, embedding)
    chosen = rows.where(F.col("vec_id") % 100 == 0 if queries is None else queries)
    index = hashed(rows, tables, 1)
    asked = hashed(chosen, tables, probes)
    found = stored(nearest_of_blocks(index, asked, nearest), "neighbours")
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= nearest)
    short = stored(
        chosen.join(enough, chosen["vec_id"] == enough["query_id"], "left_anti"), "short"
    )
    if not short.isEmpty():
        width = F.size("vector").alias("width")
        every = (F.lit(_ALL).alias("table"), F.lit(0).alias("bucket"), "vec_id", "vector")
        rest = nearest_of_blocks(rows.select(width, *every), short.select(width, *every), nearest)
        found = found.unionByName(rest)
    return _best(found, nearest)
