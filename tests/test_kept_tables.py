"""Tables kept up to date: partial sums, page index, streamed outreach, lookups by bloom filter."""
import os
import random

import pytest
from pyspark.sql import functions as F

from ballotlens.operators import accounts as acc
from ballotlens.operators import incremental as inc
from ballotlens.operators import outreach as ot
from ballotlens.operators import pages
from ballotlens.plans import fixtures as fx
from ballotlens.plans import queries as q
from ballotlens.plans import queries_tables as qt
from ballotlens.sources import sinks
from ballotlens.streaming import outreach as so
from conftest import SF_SMALL


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_read_no_account_row(spark, scratch):
    a, path = fx.accounts(spark, SF_SMALL), os.path.join(scratch, "partials")
    for k in range(3):
        inc.append_share_partials(a.filter(F.col("id") % 3 == k), path, str(k))
    inc.append_share_partials(a.filter(F.col("id") % 3 == 2), path, "2")      # a repeated load
    p = fx.table(spark, SF_SMALL, "part").selectExpr("p_partkey AS id", "p_partkey AS proposal_master_skey", "CAST(NULL AS BIGINT) AS director_master_skey")
    got = inc.totals_of_partials(p, path)
    assert "lineitem" not in executed(got) and executed(got).count("FileScan") == 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, acc.proposal_share_totals(p, a).collect()), key=str)
    two = inc.totals_of_partials(p, path, ["0", "1"])
    assert sorted(map(tuple, two.collect()), key=str) == sorted(map(tuple, acc.proposal_share_totals(p, a.filter(F.col("id") % 3 < 2)).collect()), key=str)
    assert "PartitionFilters: [cast(load" in executed(two) or "PartitionFilters: [" in executed(two)


@pytest.mark.parametrize("n,limit", [(0, 10), (1, 10), (50, 10), (51, 10), (1234, 7)])
def test_pages_as_sorted_list(spark, n, limit):
    ids = random.Random(n).sample(range(10_000), n)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string").repartition(5)
    paged = pages.with_pages(df, limit)
    want = {i: (k // limit + 1, k % limit + 1) for k, i in enumerate(sorted(ids, reverse=True))}
    assert {r.id: (r.page, r.place) for r in paged.collect()} == want
    index = pages.page_index(paged)
    for page in (1, 3, n // limit + 2):
        got = [r.id for r in pages.indexed_page(df, index, page).collect()]
        assert got == sorted(ids, reverse=True)[(page - 1) * limit:page * limit]


def test_no_window_over_the_rows(spark):
    plan = executed(pages.with_pages(spark.range(1000), 10))
    assert plan.count("Window ") == 1 and "Aggregate" in plan.split("Window ")[1]      # over partitions' counts


def test_streamed_batches_and_their_ledger(spark, scratch):
    src, table, ledger, ck = (os.path.join(scratch, n) for n in ("src", "table", "ledger", "ck"))
    schema = "id long, account_hash_key string, proposal_master_skey long, director_master_skey long"
    first = [(1, "a", 1, 1), (2, "b", 1, 1)]
    files = [[(10, "a", 1, 1), (11, "c", 1, 1), (12, "c", 1, 1), (13, None, 1, 1)], [(20, "c", 1, 1), (21, "d", 1, 1), (22, None, 1, 1)], [(30, "d", 1, 1)]]
    so.begin_table(spark.createDataFrame(first, schema), table)
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    seen = []

    def cut(number):
        seen.append(number)
        if seen.count(number) == 1 and number < 2:
            raise RuntimeError("cut")

    for _ in range(3):
        try:
            so.stream_insert_ignore(spark, src, table, ledger, ck, max_files_per_trigger=1, before_commit=cut)
        except Exception as e:  # noqa: BLE001
            assert "cut" in str(e)
    assert seen == [0, 0, 1, 1, 2]
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 11, 13, 21, 22]
    got = {r.batch: (r.source_rows, r.added, r.skipped) for r in spark.read.parquet(ledger).collect()}
    assert got == {0: (4, 2, 2), 1: (3, 2, 1), 2: (1, 0, 1)}
    so.stream_insert_ignore(spark, src, table, ledger, ck)      # nothing new
    assert spark.read.parquet(table).count() == 6


def scanned_rows(df):
    """Rows that the scan handed on, from the executed plan's own metrics."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan()
    todo = [scan]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_lookups_by_hash_skip_row_groups(spark, scratch):
    """Files sorted by proposal key, looked up by hash, with and without filters."""
    rows = spark.range(200_000).selectExpr("id", "sha2(cast(id AS string), 256) AS account_hash_key", "id % 997 AS proposal_master_skey").repartition(2)
    name = "parquet.block.size"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(name, str(256 * 1024))
    try:
        sinks.replace_table(rows, os.path.join(scratch, "with"), partition_by=None, sort_within=("proposal_master_skey", "account_hash_key"), bloom=("account_hash_key",))
        sinks.replace_table(rows, os.path.join(scratch, "without"), partition_by=None, sort_within=("proposal_master_skey", "account_hash_key"))
    finally:
        conf.unset(name)
    one = rows.filter("id = 777").first().account_hash_key
    read = {n: scanned_rows(spark.read.parquet(os.path.join(scratch, n)).filter(F.col("account_hash_key") == one)) for n in ("with", "without")}
    assert read["with"] < 0.2 * read["without"] and spark.read.parquet(os.path.join(scratch, "with")).filter(F.col("account_hash_key") == one).count() == 1


def test_issuer_join_reads_accounts_once_and_spreads_missing_keys(spark):
    plan = executed(q.q_issuer_semi_join(spark, SF_SMALL))
    assert plan.count("lineitem.parquet") == 1 and plan.count("FileScan") <= 3
    rows = [(i, f"h{i}", *k) for i, k in enumerate([(1, -1), (1, 7), (2, 7), (2, 8), (-1, 7), (None, 7), (-1, -1), (None, None), (2, None), (1, None)] * 3)]
    a = spark.createDataFrame(rows, "id long, account_hash_key string, proposal_master_skey long, director_master_skey long")
    p = spark.createDataFrame([("X", 1, -1), ("x ", 1, None), ("X", -1, 7), ("Y", 2, 8), ("X", -1, -1)], "issuer_name string, proposal_master_skey long, director_master_skey long")
    got = sorted(r.id for r in ot.issuer_semi_join(a, p, ["x"]).collect())
    assert got == [i for i, _, pm, dm in rows if pm == 1 or dm == 7]
    kept = sorted(r.id for r in ot.issuer_semi_join(a, p, ["x"], exclude_sentinel=False).collect())
    assert kept == [i for i, _, pm, dm in rows if pm in (1, -1) or dm in (7, -1)]


def test_stream_query_writes_its_loads_by_many_tasks(spark, scratch, monkeypatch):
    """No task reads the whole table to write a load; a load is a batch all the same."""
    rows = spark.range(900).selectExpr("id AS l_orderkey", "id % 40 AS l_partkey", "id % 9 AS l_suppkey", "cast(1 + id % 4 AS int) AS l_linenumber", "1D AS l_quantity",
                                       "0.04D AS l_discount", "0.02D AS l_tax", "'A' AS l_returnflag", "if(id % 3 = 0, 'F', 'O') AS l_linestatus")
    rows.unionAll(rows).repartition(4).write.parquet(os.path.join(scratch, "lineitem.parquet"))
    seen, run = [], so.stream_insert_ignore

    def watched(spark, src, table, ledger, *args, **kw):
        seen.append((sum(n.endswith(".parquet") for n in os.listdir(src)), ledger))
        return run(spark, src, table, ledger, *args, **kw)

    monkeypatch.setattr(so, "stream_insert_ignore", watched)
    got = qt.q_stream_insert_ignore(spark, scratch)
    unvoted = [(1 + i % 4, i % 40) for i in range(900) if i % 3]       # line and part, each twice
    missing = [p % 5 != 0 and p % 7 == 0 for _, p in unvoted]           # no director key: nothing is ignored
    first = sum(line <= 2 for line, _ in unvoted)
    assert got.count() == first + 2 * sum(missing) + sum(line > 2 and not m for (line, _), m in zip(unvoted, missing, strict=True))
    assert got.select("id").distinct().count() == len(unvoted)
    assert len(seen) == 4 and seen[-1][0] > 6
    assert sorted(r.batch for r in spark.read.parquet(seen[-1][1]).collect()) == [0, 1, 2]
