"""Plan guards: the properties the scale design relies on, read from the
physical plans (no nested-loop or cartesian joins, pruned scans, pushed
filters, existence joins, no single-task windows over whole tables)."""
import os

import pytest

import __spark_entry__ as E
from ballotlens.operators import accounts as acc
from ballotlens.operators import outreach as ot
from ballotlens.plans import catalog
from ballotlens.plans import fixtures as fx
from ballotlens.session import size_shuffles
from conftest import SF_SMALL

WRITERS = {"src_proposals_csv", "resumable_load", "table_inventory", "csv_roundtrip", "load_accounts",
           "load_proposals", "load_narrow_proposals", "load_outreach", "load_accounts_fill_zero", "append_table",
           "load_if_empty", "clear_dataset", "copy_outreach"}
CATALOG = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(CATALOG) - WRITERS))
def test_no_pairwise_joins(spark, key):
    p = plan(CATALOG[key](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in p
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_flagship_plan(spark):
    p = plan(E.entry(spark))
    lineitem_scan = [line for line in p.splitlines() if "lineitem" in line and "FileScan" in line][0]
    for unused in ("l_extendedprice", "l_tax", "l_returnflag", "l_shipdate"):
        assert unused not in lineitem_scan
    assert p.count("Exchange hashpartitioning") == 1          # one shuffle: the partial -> final aggregate
    assert "partial_sum" in p or "PartialMerge" in p or "HashAggregate" in p


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def below(lines, i):
    """The lines of a plan's tree under line i."""
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    for line in lines[i + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            return
        yield line


def test_issuer_join_keeps_sentinels_out(spark, no_broadcast):
    """One scan of accounts; rows without a key are filtered before it's
    shuffled, and a missing one of two keys is spread by a hash of the row."""
    p = plan(ot.issuer_semi_join(fx.accounts(spark, SF_SMALL), fx.proposals(spark, SF_SMALL), ["Brand#11"]))
    lines = p.splitlines()
    assert sum("FileScan" in x and "lineitem.parquet" in x for x in lines) == 1
    shuffles = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and any("lineitem.parquet" in y for y in below(lines, i))]
    assert len(shuffles) == 2
    for i in shuffles:
        assert "hashpartitioning(_key" in lines[i]
        assert any("Filter" in x and "-1" in x for x in below(lines, i))
        assert any("xxhash64(account_hash_key" in x and "AS _key" in x for x in below(lines, i))


def test_fact_tables_are_read_once(spark):
    for key, most in (("type_distribution", 1), ("table_counts", 2)):      # the models are a union of two reads
        assert plan(CATALOG[key](spark, SF_SMALL)).count("FileScan") == most
    assert plan(CATALOG["table_inventory"](spark, SF_SMALL)).count("FileScan") == len(fx.TABLES)


def test_lookup_pushes_filter(spark, scratch):
    path = os.path.join(scratch, "acc")
    fx.account_voted(spark, SF_SMALL).write.parquet(path)
    p = plan(acc.lookup_account(spark.read.parquet(path), "H00000007"))
    assert "PushedFilters: [IsNotNull(account_hash_key), EqualTo(account_hash_key,H00000007)]" in p


def test_dump_windows_are_partitioned(spark):
    """Windows over lines are partitioned by line block; only the per-block
    summaries (one row per block) may run unpartitioned."""
    p = plan(E.queries()["insert_batches"](spark, SF_SMALL))
    line_windows = [ln for ln in p.splitlines() if "Window [" in ln and ("row_number()" in ln or "_rs_idx" in ln)]
    assert line_windows
    for ln in line_windows:
        assert "], [_b#" in ln


def test_size_shuffles(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 100 * 1024 ** 4) == 409_600      # 100 TiB
        assert size_shuffles(spark, 10 * 1024 ** 3) == 200
        assert size_shuffles(spark, 1024 ** 4) == 4096
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_flagship_combines_hot_key_before_shuffle(spark):
    assert "partial_" in plan(CATALOG["proposal_account_join_hot"](spark, SF_SMALL))


@pytest.mark.parametrize("key", ["insert_ignore_hot", "insert_ignore", "outreach_new"])
def test_triples_are_combined_before_their_first_shuffle(spark, no_broadcast, key):
    """Below the first exchange on the key triple there is the partial
    aggregate, and no join takes rows that aren't combined."""
    lines = plan(CATALOG[key](spark, SF_SMALL)).splitlines()
    triple = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(account_hash_key#" in x and "proposal_master_skey#" in x]
    assert any("partial_min" in next(below(lines, i)) for i in triple)
    for i in triple:
        assert "Aggregate(key" in next(below(lines, i))
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin [account_hash_key" in x and ("LeftAnti" in x or "LeftOuter" in x)]
    assert joins
    for i in joins:
        assert any("_k0" in x for x in below(lines, i))


def test_number_lines_and_batches(spark, scratch):
    from ballotlens.sources import dumps
    path = os.path.join(scratch, "dump")
    os.makedirs(path)
    lines = ["-- head"] + [f"INSERT INTO `t` VALUES ({i});" for i in range(5)] + ["SET x=1;"] + \
            [f"INSERT INTO `u` VALUES ({i});" for i in range(3)]
    for name in ("a.sql", "b.sql"):
        with open(os.path.join(path, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    numbered = dumps.number_lines(spark, path)
    b = dumps.insert_statement_batches(numbered, batch_size=2, file_col="file").collect()
    per_file = {}
    for r in b:
        per_file.setdefault(r.file, []).append((r.table_name, r.batch_no, r.n_lines, r.run_start, r.first_line, r.last_line))
    assert len(per_file) == 2
    for rows in per_file.values():
        assert sorted(rows) == [("t", 0, 2, 2, 2, 3), ("t", 1, 2, 2, 4, 5), ("t", 2, 1, 2, 6, 6), ("u", 0, 2, 8, 8, 9), ("u", 1, 1, 8, 10, 10)]
    p = plan(numbered)
    assert "Python" not in p and "ExistingRDD" not in p


def test_lines_are_numbered_across_splits(spark, scratch):
    from ballotlens.sources import dumps
    path = os.path.join(scratch, "long.sql")
    with open(path, "w") as f:
        f.write("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = dumps.number_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_no, r.line) for r in rows) == [(i, f"line {i}") for i in range(1, 5001)]


def test_issuer_list_is_a_semi_join(spark):
    from ballotlens.operators import proposals as pr
    names = [f"Brand#{i}" for i in range(1, 3000)]
    small = pr.issuer_in(fx.proposals(spark, SF_SMALL), names[:2])
    big = pr.issuer_in(fx.proposals(spark, SF_SMALL), names)
    for p in (plan(small), plan(big)):
        assert "LeftSemi" in p and "hint" not in p.lower()
    assert small.count() <= big.count() == fx.proposals(spark, SF_SMALL).filter(
        "issuer_name IS NOT NULL AND lower(rtrim(issuer_name)) LIKE 'brand#%'").count()
