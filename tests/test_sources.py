"""Sources and sinks: header binding, resumable load, partition replace, dump batches."""
import os

from pyspark.sql import functions as F

from ballotlens.operators import shape as sh
from ballotlens.sources import dumps, readers, sinks
from ballotlens.streaming.resumable import resumable_load


def test_csv_binds_by_name(spark, scratch):
    a, b = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    spark.createDataFrame([("1", "x")], "k string, v string").write.option("header", True).csv(a)
    spark.createDataFrame([("y", "2")], "v string, k string").write.option("header", True).csv(b)
    rows = sorted(tuple(r) for r in readers.read_csv_by_name(spark, [a, b]).select("k", "v").collect())
    assert rows == [("1", "x"), ("2", "y")]


def test_resumable_load_exactly_once(spark, scratch):
    src, dst, ck = (os.path.join(scratch, n) for n in ("src", "dst", "ck"))
    spark.range(100).repartition(4).write.parquet(src)
    resumable_load(spark, src, dst, ck, max_files_per_trigger=1)
    assert spark.read.parquet(dst).count() == 100
    spark.range(100, 130).repartition(2).write.mode("append").parquet(src)
    resumable_load(spark, src, dst, ck)
    resumable_load(spark, src, dst, ck)
    out = spark.read.parquet(dst)
    assert out.count() == 130 and out.distinct().count() == 130


def test_replace_keeps_other_datasets(spark, scratch):
    path = os.path.join(scratch, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, dataset string")
    sinks.replace_table(df, path)
    sinks.replace_table(spark.createDataFrame([(3, "a")], "x int, dataset string"), path)
    got = sorted((r.x, r.dataset) for r in spark.read.parquet(path).collect())
    assert got == [(2, "b"), (3, "a")]
    assert sinks.load_if_empty(df, path) == "skipped"


def test_load_datasets_skips_missing(spark, scratch):
    a = os.path.join(scratch, "a")
    spark.range(3).write.parquet(a)
    out = readers.load_datasets(spark, {a: "one", os.path.join(scratch, "nope"): "two"})
    assert sorted(r.dataset for r in out.collect()) == ["one"] * 3


def _brute_batches(lines, batch):
    out, prev, start, pos = {}, None, None, 0
    for no, line in sorted(lines):
        t = line.split("`")[1] if line.startswith("INSERT INTO `") and line.endswith(");") else None
        if t is not None and t == prev:
            pos += 1
        elif t is not None:
            start, pos = no, 0
        prev = t
        if t is not None:
            k = (t, start, pos // batch)
            lo, hi, n = out.get(k, (no, no, 0))
            out[k] = (min(lo, no), max(hi, no), n + 1)
    return sorted((k[0], k[1], k[2], v[0], v[1], v[2]) for k, v in out.items())


def test_insert_batches_against_brute_force(spark):
    lines = []
    for i in range(1, 400):
        if i % 53 == 0:
            continue                      # gaps in the numbering
        if i % 41 == 0:
            lines.append((i, "-- note"))
        else:
            t = "a" if (i // 70) % 2 == 0 else "b"
            lines.append((i, f"INSERT INTO `{t}` VALUES ({i});"))
    df = spark.createDataFrame(lines, "line_no long, line string")
    got = dumps.insert_statement_batches(df, batch_size=7, block_lines=16).collect()
    got = sorted(tuple(r) for r in got)
    assert got == _brute_batches(lines, 7)


def test_fuzzy_alias_conflict(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "score int")
    with pytest.raises(ValueError):
        sh.fuzzy_alias(df, ["score_model1", "score_model2"])
    assert sh.alias_columns(spark.createDataFrame([(1, 2)], "score int, score_model int")).columns == \
        ["score_model2", "score_model"]


def test_copy_clear_append(spark, scratch):
    from ballotlens.operators import outreach as ot
    schema = ("id long, account_hash_key string, proposal_master_skey long, director_master_skey long, "
              "shares_summable double")
    target = os.path.join(scratch, "outreach")
    spark.createDataFrame([(1, "a", 1, 2, 1.0)], schema).write.parquet(target)
    src = spark.createDataFrame([(5, "a", 1, 2, 1.0), (6, "b", 1, 2, 2.0), (7, "b", 1, 2, 3.0)], schema)
    rep = sinks.copy_table(src, target, ot.copy_rows, columns=["id", "account_hash_key", "proposal_master_skey",
                                                            "director_master_skey", "shares_summable"]).first()
    assert (rep.source_rows, rep.copied, rep.skipped) == (3, 1, 2)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 6]

    table = os.path.join(scratch, "accounts")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, dataset string")
    sinks.append_table(df, table)
    sinks.append_table(df, table)
    assert spark.read.parquet(table).count() == 4
    import pytest
    with pytest.raises(ValueError):
        sinks.clear_dataset(spark, table, "x")
    with pytest.raises(ValueError):
        sinks.clear_dataset(spark, table, "z", confirm=True)
    sinks.clear_dataset(spark, table, "x", confirm=True)
    assert sorted(r.v for r in spark.read.parquet(table).collect()) == [2, 2]


def test_delete_where_new_version(spark, scratch):
    old, new = os.path.join(scratch, "v1"), os.path.join(scratch, "v2")
    spark.createDataFrame([("test_hash_1",), ("test_hash_2",), ("keep",)], "k string").write.parquet(old)
    out = sinks.delete_where(spark, old, new, "k", "test_hash_%")
    assert [r.k for r in out.collect()] == ["keep"]
    assert spark.read.parquet(old).count() == 3


def test_samples_are_the_same_for_any_partitioning(spark):
    from ballotlens.sources import generate
    rows = [(i, f"H{i % 7}" if i % 5 else None, i * 37 if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, account_hash_key string, shares_summable long")
    a, b = (generate.sample_accounts(df.repartition(n), "s").collect() for n in (1, 7))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    real, got = {r[0]: r for r in rows}, {r.id: r for r in a}
    assert all((got[i].account_hash_key is None) == (real[i][1] is None) for i in real)
    assert len({r.account_hash_key for r in a if r.account_hash_key}) == 7 and all(r.shares_summable is None or r.shares_summable % 100 == 0 for r in a)
    p = spark.createDataFrame([(1, "Acme", "k", "t"), (2, "ACME  ", "k2", "t"), (3, None, None, None)], "id long, issuer_name string, final_key string, proposal string")
    out = generate.sample_proposals(p, "s").orderBy("id").collect()
    assert out[0].issuer_name == out[1].issuer_name != "Acme" and out[2].issuer_name is None and out[2].proposal == "Proposal 3"


def test_load_proposals_keeps_every_row(spark, scratch):
    from ballotlens.plans import load as ld
    raw = spark.createDataFrame([("1", "Acme", "0.5", "true"), ("2", "Beta", "oops", "false"), ("-1", "Gamma", "", "yes")],
                                "proposal_master_skey string, issuer_name string, VotingRatio string, approved string")
    rep = ld.load_proposals(raw, os.path.join(scratch, "p"), dataset="x")
    assert rep == {"imported": 3, "errors": 0, "bad_cells": {"voting_ratio": 1}}
    got = spark.read.parquet(os.path.join(scratch, "p")).select("proposal_master_skey", "voting_ratio", "approved")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0.5, True), (2, None, False), (None, None, True)], key=str)


def test_narrow_load_budget_and_rejects(spark, scratch):
    import pytest
    from ballotlens.plans import load as ld
    raw = spark.createDataFrame([("1", "1", "x"), ("2.0", "1", "2.5"), ("", "maybe", ""), (" 3 ", "", "1e400")],
                                "proposal_master_skey string, approved string, for_percentage string")
    with pytest.raises(RuntimeError):
        ld.load_narrow_proposals(raw, os.path.join(scratch, "n"), "x", max_errors=1)
    assert not os.path.exists(os.path.join(scratch, "n"))
    rep = ld.load_narrow_proposals(raw, os.path.join(scratch, "n"), "x", rejects_path=os.path.join(scratch, "r"))
    assert rep == {"imported": 2, "errors": 2}
    assert sorted(map(tuple, spark.read.parquet(os.path.join(scratch, "n")).select("proposal_master_skey", "approved", "for_percentage").collect())) == \
        [(1, True, None), (3, False, None)]
    assert spark.read.parquet(os.path.join(scratch, "r")).count() == 2


def test_untyped_null_columns_can_share_a_table(spark, scratch):
    from ballotlens.plans import load as ld
    path = os.path.join(scratch, "acc")
    a = spark.createDataFrame([("h", 1, 2, "T", 1.5)], "account_hash_key string, proposal_master_skey long, director_master_skey long, account_type string, shares_summable double")
    ld.load_accounts(a, path, "d", 0)
    ld.load_accounts(a.withColumn("Target_encoded", F.lit(2)), path, "d", 1)
    assert sorted(((r.is_voted, r.Target_encoded) for r in spark.read.parquet(path).collect())) == [(0, None), (1, 2)]


def test_slim_accounts_swaps_and_keeps_a_backup(spark, scratch):
    path = os.path.join(scratch, "wide")
    spark.createDataFrame([(1, "u", "h", "d"), (2, "u", "g", "e")], "row_index int, unnamed_col string, account_hash_key string, dataset string") \
        .write.partitionBy("dataset").parquet(path)
    r = sinks.slim_accounts(spark, path, "20260101")
    assert r["rows"] == 2 and spark.read.parquet(path).columns == ["account_hash_key", "dataset"]
    assert "row_index" in spark.read.parquet(r["backup"]).columns


def test_union_of_proposal_forms(spark):
    from ballotlens.operators import validate as va
    wide = sh.normalise_proposals(spark.createDataFrame([("1", "A", "1/2/2024", "5")], "proposal_master_skey string, issuer_name string, mt_date string, total_for_shares string"))
    narrow = sh.normalise_narrow_proposals(spark.createDataFrame([("2", "B", "3/4/2024", "2.5")], "proposal_master_skey string, issuer_name string, meeting_date string, total_for_shares string")).drop("_failed")
    both = sh.union_proposal_forms(wide, narrow)
    r = va.verify_dataset(both).first()
    assert (r.rows, str(r.first_meeting), str(r.last_meeting)) == (2, "2024-01-02", "2024-03-04")
    assert sorted(x.total_for_shares for x in both.collect()) == [2.5, 5.0]
