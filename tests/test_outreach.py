"""Duplicate-free outreach: NULL keys never conflict, re-runs insert nothing new."""
from pyspark.sql import functions as F

from ballotlens.operators import outreach as ot
from ballotlens.plans import fixtures as fx
from conftest import SF_SMALL

SCHEMA = ("id long, account_hash_key string, proposal_master_skey long, director_master_skey long, "
          "shares_summable double")


def test_insert_ignore_null_keys(spark):
    rows = spark.createDataFrame([(1, "h", 1, None, 1.0), (2, "h", 1, None, 2.0), (3, "h", 1, 5, 3.0),
                                  (4, "h", 1, 5, 4.0)], SCHEMA)
    target = spark.createDataFrame([], SCHEMA)
    got = sorted(r.id for r in ot.insert_ignore(target, rows).collect())
    assert got == [1, 2, 3]          # NULL-key rows both go in; the pair keeps its first row


def test_add_to_outreach_invariants(spark):
    u = fx.account_unvoted(spark, SF_SMALL)
    sel = u.filter(F.col("rank_of_shareholding") <= 3)
    o = fx.outreach(spark, SF_SMALL)
    res = ot.add_to_outreach(sel, o)
    rep = res["report"].first()
    n_sel = sel.count()
    n_new, n_dup = res["new"].count(), res["duplicates"].count()
    assert (rep.inserted, rep.skipped) == (n_new, n_dup)
    keyed = sel.filter(F.col("proposal_master_skey").isNotNull() & F.col("director_master_skey").isNotNull())
    in_batch = (keyed.join(o.select(*ot.KEYS).distinct(), list(ot.KEYS), "left_anti").count()
                - keyed.join(o.select(*ot.KEYS).distinct(), list(ot.KEYS), "left_anti").select(*ot.KEYS).distinct().count())
    assert n_new + n_dup + in_batch == n_sel
    # a second run against outreach + new rows adds no row with a full key
    o2 = o.unionByName(res["new"], allowMissingColumns=True)
    again = ot.add_to_outreach(sel, o2)["new"]
    assert again.filter(F.col("proposal_master_skey").isNotNull() & F.col("director_master_skey").isNotNull()).count() == 0


def test_in_outreach_null_safe(spark):
    u = spark.createDataFrame([(1, "h", 1, None, 1.0), (2, "h", 1, 2, 1.0)], SCHEMA)
    o = spark.createDataFrame([(9, "h", 1, None, 1.0)], SCHEMA)
    flags = {r.id: r.in_outreach for r in ot.in_outreach(u, o).collect()}
    assert flags == {1: True, 2: False}


def test_delete_where_like(spark):
    df = spark.createDataFrame([("test_hash_1",), ("testXhash_2",), ("other",), (None,)], "k string")
    assert sorted(r.k or "" for r in ot.delete_where_like(df, "k", "test_hash_%").collect()) == ["", "other"]


def test_add_to_outreach_materialized_same(spark):
    u = fx.account_unvoted(spark, SF_SMALL)
    sel = u.filter(F.col("rank_of_shareholding") <= 3)
    o = fx.outreach(spark, SF_SMALL)
    a = ot.add_to_outreach(sel, o)
    b = ot.add_to_outreach(sel, o, materialize=True)
    assert tuple(a["report"].first()) == tuple(b["report"].first())
    assert sorted(map(tuple, a["new"].collect())) == sorted(map(tuple, b["new"].collect()))
