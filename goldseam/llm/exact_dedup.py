"""Exact duplicates by a tree merge of sorted digest runs.

Each scan partition belongs to a run of (digest, keeper, size) entries.  In every round the runs
that share a parent exchange entries and merge, ``FAN_IN`` runs into one, until one logical run is
left; a round moves digests only and keeps one entry per digest and run, so a group of copies that
holds a third of all rows is one entry per run after the first round.  A run never sits in one
task: its entries are dealt by digest over all shuffle partitions.  Entries merge only if the
SHA-256 digest, an independent 64-bit hash and the byte length all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import SPACE, stored, text_of

FAN_IN = 8

_KEY = ("text_sha256", "_bytes", "_check")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its identifier, digests of the normalised text and its run."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.length(text_of(text)).alias("_points"),
        F.regexp_replace(text_of(text), SPACE + "+", "").alias("_norm"),
    )
    return rows.select(
        "doc_id",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_norm").alias("_bytes"),
        F.xxhash64("_norm").alias("_check"),
        "_points",
        F.monotonically_increasing_id().alias("_row"),
        F.spark_partition_id().alias("_run"),
    )


def merge_runs(entries: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge all runs; returns (key, _keep, group_size) with one row per distinct text."""
    merged = entries.select(
        *_KEY,
        "_run",
        F.struct(
            (-F.col("_points")).alias("shorter"),
            F.col("doc_id").isNull().alias("nameless"),
            F.col("doc_id").alias("doc_id"),
            F.col("_row").alias("row"),
        ).alias("_keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    while True:
        runs = -(-runs // fan_in)
        parent = F.floor(F.col("_run") / fan_in).cast("int")
        merged = merged.groupBy(*_KEY, parent.alias("_run")).agg(
            F.min("_keep").alias("_keep"), F.sum("group_size").alias("group_size")
        )
        if runs <= 1:
            return merged.drop("_run")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null counts as empty.  Of
    equal texts the one with the most code points stays, then the smallest doc_id (null last),
    then the first of rows equal in both; exactly one row of a group is ``kept``.  An empty table
    gives no rows.  Other columns are not read, so their names don't matter.
    """
    entries = stored(fingerprints(docs, doc_id, text), "fingerprints")
    runs = entries.agg(F.max("_run")).first()[0]
    groups = merge_runs(entries, (runs or 0) + 1, fan_in).where("group_size > 1")
    keep = F.col("_keep")
    return entries.join(groups, list(_KEY), "left").select(
        "doc_id",
        F.when(keep.isNull(), F.col("doc_id")).otherwise(keep["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.isNull() | (keep["row"] == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
