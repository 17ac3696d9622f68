"""Tables bucketed by a join key: results, hot keys apart, no exchange of the table."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from ballotlens.sources import buckets

# a key with a third of all rows, NULL with a third, and many small ones
ROWS = [(i, 5 if i % 3 == 0 else None if i % 3 == 1 else 10 + i % 41, i % 7) for i in range(900)]


@pytest.fixture()
def name(spark, scratch):
    n = f"t_{uuid.uuid4().hex[:8]}"
    buckets.write_bucketed(spark.createDataFrame(ROWS, "id long, k long, v long"), n, os.path.join(scratch, "t"), "k", 16)
    yield n
    for t in (n, f"{n}_hot"):
        spark.sql(f"DROP TABLE {t}")


def test_hot_keys_lie_apart(spark, name):
    assert {r.k for r in spark.table(f"{name}_hot").select("k").distinct().collect()} == {5, None}
    assert sorted(map(str, buckets.read_bucketed(spark, name).collect())) == sorted(map(str, spark.createDataFrame(ROWS, "id long, k long, v long").collect()))
    got = {r.k: (r.rows, r.total) for r in buckets.totals_by_key(spark, name, "k", "v").collect()}
    want = {k: (sum(r[1] == k for r in ROWS), sum(r[2] for r in ROWS if r[1] == k)) for k in {r[1] for r in ROWS}}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_as_plain_ones(spark, name, how):
    other = spark.createDataFrame([(5, "hot"), (12, "a"), (12, "b"), (None, "none"), (99, "no one")], "k long, t string")
    got = buckets.join_bucketed(spark, name, other, "k", how)
    want = spark.createDataFrame(ROWS, "id long, k long, v long").join(other, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_exchange_of_the_table(spark, name):
    other = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table(name).join(other, "k")._jdf.queryExecution().executedPlan().toString()
        rolled = spark.table(name).groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan
    assert "Exchange " not in rolled
    with pytest.raises(ValueError):
        buckets.join_bucketed(spark, name, other, "k", "full")


def test_empty_table(spark, scratch):
    n = f"t_{uuid.uuid4().hex[:8]}"
    buckets.write_bucketed(spark.createDataFrame([], "id long, k long, v long"), n, os.path.join(scratch, "t"), "k", 16)
    assert buckets.read_bucketed(spark, n).count() == 0 == buckets.totals_by_key(spark, n, "k", "v").count()


def test_more_buckets_where_they_would_hold_many_rows(spark, scratch):
    """A bucket, which one task sorts, doesn't grow with the table."""
    n = f"t_{uuid.uuid4().hex[:8]}"
    rows = spark.createDataFrame(ROWS, "id long, k long, v long")
    buckets.write_bucketed(rows, n, os.path.join(scratch, "t"), "k", 4, bucket_rows=30)
    try:
        held = spark.table(n).groupBy(F.input_file_name()).count().collect()
        assert len(held) > 8 and max(r["count"] for r in held) <= 4 * 30
        assert spark.sql(f"DESCRIBE EXTENDED {n}").filter("col_name = 'Num Buckets'").first().data_type == "30"
        assert sorted(map(str, buckets.read_bucketed(spark, n).collect())) == sorted(map(str, rows.collect()))
    finally:
        for t in (n, f"{n}_hot"):
            spark.sql(f"DROP TABLE {t}")
