"""Session settings that matter at scale."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Compressed input per shuffle partition; rows take several times as much in memory.
PARTITION_BYTES = 64 * 1024 * 1024

_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_FORCE_SKEW_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        _FORCE_SKEW_SPLIT: "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions_for(
    input_bytes: int, at_least: int = 1, partition_bytes: int = PARTITION_BYTES
) -> int:
    """Initial shuffle partitions for an input size; adaptive execution coalesces down."""
    return max(math.ceil(input_bytes / partition_bytes), at_least)


@contextmanager
def sized(
    spark: SparkSession, input_bytes: int = 0, partition_bytes: int = PARTITION_BYTES
) -> Iterator[SparkSession]:
    """What the plans of one stage rely on, set for as long as the stage runs.

    Shuffles get a partition per ``partition_bytes`` of input.  Aggregates that reuse a join's
    partitioning would stop adaptive execution from splitting a hot join key, because the split
    costs them one more shuffle.  Forcing the split pays for that shuffle only when a partition
    really is skewed.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        _FORCE_SKEW_SPLIT: "true",
        _INITIAL_PARTITIONS: str(shuffle_partitions_for(input_bytes, current, partition_bytes)),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
