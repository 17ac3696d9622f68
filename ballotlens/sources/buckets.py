"""Account tables bucketed by a join key.

Rows are shuffled once, as the table is written; joins and roll-ups by the key
then read bucket against bucket and shuffle the other side only.  A bucket is
one task, so keys with more rows than two even buckets (NULL among them) lie in
a plain table beside it, whose joins AQE may split or broadcast.  Every row is
in exactly one of the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000     # rows of an even bucket; a task sorts one bucket


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, bucket_rows: int = BUCKET_ROWS) -> None:
    """Tables ``name`` and ``name_hot`` of the session's catalog, with files (and
    the hot keys, fewer than half the buckets) under ``path``.  ``buckets`` is
    the least number of buckets: there are more where even ones would hold over
    ``bucket_rows`` rows, so a bucket doesn't grow with the table.  ``df`` is
    read four times: for its rows, the keys' counts, and either table."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = max(buckets, min(-(-total // bucket_rows), most))
    counts.filter(F.col("n") * buckets > 2 * total).select("_hot_key").write.mode("overwrite").parquet(f"{path}/hot_keys")
    hot = spark.read.parquet(f"{path}/hot_keys")
    same = F.col(key).eqNullSafe(F.col("_hot_key"))
    df.join(hot, same, "left_semi").write.mode("overwrite").option("path", f"{path}/hot").saveAsTable(f"{name}_hot")
    # a task writes one bucket: as many files as buckets
    df.join(hot, same, "left_anti").repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/cold") \
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """All rows."""
    return spark.table(name).unionByName(spark.table(f"{name}_hot"))


def join_bucketed(spark: SparkSession, name: str, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The bucketed table's rows joined to ``other`` on ``key``, which both name
    so: inner, left, left_semi or left_anti, which judge each row by itself."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the bucketed table are joined one by one, not {how}")
    cold, hot = spark.table(name), spark.table(f"{name}_hot")
    return cold.join(other, key, how).unionByName(hot.join(other, key, how))


def totals_by_key(spark: SparkSession, name: str, key: str, value: str) -> DataFrame:
    """(key, rows, total): no bucketed row is shuffled, hot rows are summed by
    task before they are; a key is in one of the tables only."""
    def rolled(t: str) -> DataFrame:
        return spark.table(t).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))

    return rolled(name).unionByName(rolled(f"{name}_hot"))
