"""Row groups as a table, and loads that go on inside a file."""
import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ballotlens.sources import row_groups as rg

ROWS = {"id": list(range(1000)), "name": [None if i % 7 == 0 else f"n{i % 13}" for i in range(1000)],
        "at": [datetime.datetime(2024, 1, 5, 10, tzinfo=datetime.UTC) + datetime.timedelta(minutes=i) for i in range(1000)],
        "parts": [[i, None] if i % 3 else None for i in range(1000)]}


def _write(folder, name, rows, size):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    pq.write_table(rows, path, row_group_size=size)
    return path


@pytest.fixture()
def source(scratch):
    t = pa.table(ROWS)
    _write(f"{scratch}/src", "a.parquet", t.slice(0, 700), 100)     # 7 groups
    _write(f"{scratch}/src/deep", "b 100%.parquet", t.slice(700, 300), 90)   # 4 groups, one of 30 rows
    _write(f"{scratch}/src", "none.parquet", t.slice(0, 0), 90)
    return f"{scratch}/src"


def _all(df):
    return sorted((r["id"], r["name"], r["at"], r["parts"]) for r in df.collect())


def test_inventory(spark, source):
    got = sorted((os.path.basename(r.file_path), r.row_group, r.first_row, r.rows, r.columns) for r in rg.row_groups(spark, source).collect() if r.rows)
    assert got == [("a.parquet", g, 100 * g, 100, 4) for g in range(7)] + [("b 100%.parquet", g, 90 * g, 90 if g < 3 else 30, 4) for g in range(4)]


def test_chosen_groups_only(spark, source):
    groups = rg.row_groups(spark, source).filter("row_group = 3")
    schema = spark.read.parquet(f"{source}/a.parquet").select("id", F.lit(None).cast("int").alias("other")).schema
    assert sorted(tuple(r) for r in rg.read_groups(groups, schema).collect()) == [(i, None) for i in [*range(300, 400), *range(970, 1000)]]


def test_load_stopped_inside_a_file_goes_on(spark, source, scratch):
    """Stopped before a commit, again before the next, then with other batches and a new file."""
    target, done = f"{scratch}/target", f"{scratch}/ledger"
    total = rg.row_groups(spark, source).agg(F.sum("bytes")).first()[0]

    def stop_at(n):
        def stop(batch):
            if batch == n:
                raise RuntimeError("stopped")
        return stop

    for n in (2, 3):
        with pytest.raises(RuntimeError, match="stopped"):
            rg.load_row_groups(spark, source, target, done, batch_bytes=total // 5, before_commit=stop_at(n))
    part = rg.loaded(spark, target, done)
    assert 0 < part.count() < 1000 and part.count() == rg.ledger(spark, done).agg(F.sum("rows")).first()[0]
    assert part.select("id").distinct().count() == part.count()
    # some file is loaded in part
    in_part = rg.ledger(spark, done).groupBy("file_path").count().join(rg.row_groups(spark, source).groupBy("file_path").agg(F.count("*").alias("n")), "file_path")
    assert in_part.filter("count < n").count() > 0
    rg.load_row_groups(spark, source, target, done)
    assert _all(rg.loaded(spark, target, done)) == _all(spark.read.option("recursiveFileLookup", "true").parquet(source))
    assert rg.load_row_groups(spark, source, target, done) == 0
    _write(source, "c.parquet", pa.table(ROWS).slice(0, 10), 4)
    assert rg.load_row_groups(spark, source, target, done) == 1
    assert rg.loaded(spark, target, done).count() == 1010
    assert spark.read.parquet(target).count() == 1010


def test_changed_file_is_an_error(spark, source, scratch):
    rg.load_row_groups(spark, source, f"{scratch}/t", f"{scratch}/l")
    _write(source, "a.parquet", pa.table(ROWS), 100)
    with pytest.raises(ValueError, match="changed"):
        rg.load_row_groups(spark, source, f"{scratch}/t", f"{scratch}/l")


def test_batch_without_rows_replaces_what_was_left(spark, source, scratch):
    """A stopped run's rows go even if the transform keeps none the next time."""
    target, done = f"{scratch}/t", f"{scratch}/l"

    def stop(batch):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        rg.load_row_groups(spark, source, target, done, before_commit=stop)
    rg.load_row_groups(spark, source, target, done, transform=lambda d: d.filter("id < 0"))
    assert spark.read.parquet(target).count() == 0
    assert rg.ledger(spark, done).agg(F.sum("rows")).first()[0] == 1000


def test_a_task_opens_a_file_once(spark, source):
    """Not once for each row group: its footer names them all."""
    dealt = rg.deal(rg.row_groups(spark, source).filter("rows > 0"), 1 << 30)
    assert dealt.rdd.getNumPartitions() == 1
    opened = []

    def opening(path):
        opened.append(path)
        return rg._open(path)

    got = pa.Table.from_batches(rg.stream_groups(dealt.toArrow().to_batches(3), pa.schema([("id", pa.int64())]), opening))
    assert sorted(got["id"].to_pylist()) == list(range(1000)) and len(opened) == 2


def test_row_groups_are_dealt_by_stretches(spark):
    """A file of many row groups is opened by few tasks, and tasks stay small."""
    groups = spark.range(4000).selectExpr("concat('f', id % 2) AS file_path", "cast(id div 2 AS int) AS row_group", "1000L AS bytes")
    dealt = rg.deal(groups, 100_000).withColumn("task", F.spark_partition_id()).cache()
    assert dealt.rdd.getNumPartitions() == 40 and dealt.distinct().count() == 4000 and dealt.select("file_path", "row_group").distinct().count() == 4000
    neighbours = dealt.alias("a").join(dealt.alias("b"), F.expr("a.file_path = b.file_path and a.row_group + 1 = b.row_group and a.task = b.task")).count()
    assert neighbours > 0.9 * 4000 and dealt.groupBy("task").count().agg(F.max("count")).first()[0] <= 400
