"""Share totals kept up to date load by load.

Every load of accounts leaves a roll-up by key, a partition of its own in a
table of partial sums.  Counts and sums add up, so totals over all loads read
the partials, a row a (load, key), and no account row again.  A load that is
repeated replaces its own partition: nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.operators import accounts as acc
from ballotlens.sources import sinks

SUMS = ("nv", "nu", "vs", "us", "f", "g")


def append_share_partials(accounts: DataFrame, path: str, load: str, **kw) -> None:
    """Roll up one load's accounts into its partition ``load`` of the table at ``path``."""
    sinks.replace_table(acc.rollup_by_key(accounts, **kw).withColumn("load", F.lit(load)), path, partition_by=("load",))


def _added(partials: DataFrame) -> DataFrame:
    return partials.groupBy("key_type", "key_value").agg(*(F.sum(c).alias(c) for c in SUMS))


def rollup_of_partials(spark: SparkSession, path: str, loads: list[str] | None = None) -> DataFrame:
    """The roll-up by key over all loads, or some."""
    partials = spark.read.parquet(path)
    return _added(partials.filter(F.col("load").cast("string").isin(loads)) if loads is not None else partials)


def totals_of_partials(proposals: DataFrame, path: str, loads: list[str] | None = None) -> DataFrame:
    """``proposal_share_totals`` from the partials."""
    return acc.totals_of_rollup(proposals, rollup_of_partials(proposals.sparkSession, path, loads))


def compact_partials(spark: SparkSession, path: str, new_path: str, load: str = "compacted") -> None:
    """All loads so far as one partition of a new table: totals stay, and the
    partials no longer grow with the number of loads."""
    sinks.replace_table(rollup_of_partials(spark, path).withColumn("load", F.lit(load)), new_path, partition_by=("load",))
