"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is the repetition rate
of its source: (rows wanted of the source) / (rows it has).  The variable is the inverse of the
distribution at a uniform number taken from a hash of seed and identifier, so a rerun, or a lost
executor, makes the same copies.  Rates above ``BLOCK`` are drawn as sums of smaller variables,
which keeps the inversion short and exact at any rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import back, renamed, stored

SEED = "mix-1"
BLOCK = 32.0  # largest mean of one inverted variable
UNIFORM_DIGITS = 13  # hexadecimal digits of an MD5 hash: 52 bits of a uniform number


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    digits = F.conv(F.substring(digest, 1, UNIFORM_DIGITS), 16, 10)
    return digits.cast("double") / float(16**UNIFORM_DIGITS)


def rates(
    docs: DataFrame,
    source: str = "source",
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    total: int | None = None,
) -> DataFrame:
    """One row per source: source, n_docs, rate, and the inversion's mean, blocks and table.

    The share of a source is its entry in ``weights`` (0 where it has none) or, without weights,
    its size to the power ``exponent``.  ``total`` rows are wanted, by default as many as there are.
    A null source is a source of its own; its entry in ``weights`` has the key None.
    """
    counted = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(exponent))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            hit = F.col("source").eqNullSafe(F.lit(name).cast("string"))
            share = F.when(hit, float(weight)).otherwise(share)
    shared = counted.withColumn("share", share)
    shares, rows = shared.agg(F.sum("share"), F.sum("n_docs")).first()
    wanted = float(total if total is not None else rows or 0)
    rate = wanted * F.col("share") / (shares or 1.0) / F.col("n_docs")
    rated = shared.select("source", "n_docs", rate.alias("rate"))
    blocks = F.greatest(F.ceil(F.col("rate") / BLOCK), F.lit(1)).cast("int")
    rated = rated.withColumn("blocks", blocks).withColumn("mean", F.expr("rate / blocks"))
    # Beyond the last entry the tail is far below the 52 bits of the uniform number.
    last = F.ceil(F.expr("mean + 12 * sqrt(mean)") + 24).cast("int")
    table = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(
            F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")
        ),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k).alias("p"),
            F.concat(
                acc["cdf"],
                F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k),
            ).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return rated.withColumn("cdf", table)


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    total: int | None = None,
    seed: str = SEED,
    copy_column: str | None = None,
    key_column: str | None = None,
) -> DataFrame:
    """The copies of all documents, in a random order: the partitions and the rows in them.

    All columns are kept; ``copy_column`` adds the number of the copy, from 1, and ``key_column``
    the key of the order.  A document with count 0 goes.  Rows with the same doc_id draw the same
    number; a null doc_id draws as an empty one.  Texts are not looked at.  An empty table gives
    an empty table.  ``rates`` tells how weights, sources and nulls in them are taken.
    """
    plain, names = renamed(docs)
    plain = plain.withColumn(
        "_name", F.coalesce(F.col(names[doc_id]).cast("string"), F.lit(""))
    )
    # Stored, the table has a known size, by which Spark decides whether to broadcast it.
    table = stored(rates(docs, source, weights, exponent, total), "rates").select(
        F.col("source").alias("_mixed"), "blocks", "cdf"
    )
    uniforms = F.transform(
        F.sequence(F.lit(1), F.col("blocks")),
        lambda block: uniform(F.lit(seed), F.col("_name"), block.cast("string")),
    )
    drawn = F.aggregate(
        uniforms,
        F.lit(0),
        lambda count, u: count + F.size(F.filter("cdf", lambda c: c <= u)),
    )
    copies = (
        plain.join(table, F.col(names[source]).eqNullSafe(F.col("_mixed")))
        .withColumn("_count", drawn)
        .where("_count > 0")
        .select(*names.values(), "_name", F.explode(F.expr("sequence(1, _count)")).alias("_copy"))
    )
    key = F.md5(
        F.concat_ws("|", F.lit(seed), F.lit("order"), "_name", F.col("_copy").cast("string")).cast(
            "binary"
        )
    )
    shuffled = (
        copies.withColumn("_key", key).repartition(F.col("_key")).sortWithinPartitions("_key")
    )
    columns = back(names)
    if copy_column:
        columns.append(F.col("_copy").cast("long").alias(copy_column))
    if key_column:
        columns.append(F.col("_key").alias(key_column))
    return shuffled.select(*columns)
