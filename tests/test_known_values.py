"""Published numbers: the fixture's known values and the metrics golden."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ballotlens.operators import quality as qm
from ballotlens.plans import fixtures as fx
from conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("sf,rows,nokey,needed,f,g,u", [
    (SF_SMALL, 200, 4, 76, "34208.00", "28493.00", "67399.00"),
    (SF_MID, 2000, 48, 744, "344876.00", "279148.00", "675616.00"),
])
def test_flagship_known_values(spark, sf, rows, nokey, needed, f, g, u):
    df = E.queries()["proposal_account_join"](spark, sf)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key_type").isNull()).alias("nokey"),
               F.count("shares_needed").alias("needed"), F.sum("voted_for_shares").alias("f"),
               F.sum("voted_against_shares").alias("g"), F.sum("unvoted_shares").alias("u")).first()
    assert (r.n, r.nokey, r.needed) == (rows, nokey, needed)
    assert (str(r.f), str(r.g), str(r.u)) == (f, g, u)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 200
    assert "shares_needed" in df.columns


@pytest.mark.parametrize("sf,cm,d1", [
    (SF_SMALL, (84, 33, 44, 27), (185, 55, 100, 147, 170)),
    (SF_MID, (765, 398, 448, 271), (1847, 508, 987, 1442, 1683)),
])
def test_quality_known_values(spark, sf, cm, d1):
    p = fx.proposals(spark, sf)
    m = qm.confusion_matrix(p).first()
    assert (m.tp, m.fp, m.fn, m.tn) == cm
    t = {r.threshold: r for r in qm.threshold_table(p).filter(F.col("metric") == "delta1").collect()}
    assert t[0.15].total == d1[0]
    assert tuple(t[x]["count"] for x in (0.15, 0.30, 0.50, 0.75)) == d1[1:]


def test_metrics_golden(spark):
    m = spark.createDataFrame([(85, 12, 8, 95)], "tp long, fp long, fn long, tn long")
    r = qm.classification_metrics(m).first()
    assert round(r.accuracy * 100, 1) == 90.0
    assert round(r.precision * 100, 1) == 87.6
    assert round(r.recall * 100, 1) == 91.4
    assert round(r.f1_score * 100, 1) == 89.5


def test_metrics_zero_denominators(spark):
    m = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    r = qm.classification_metrics(m).first()
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (0.0, 0.0, 0.0, 0.0)


def test_quality_invariants(spark):
    p = fx.proposals(spark, SF_MID)
    m = qm.confusion_matrix(p).first()
    assert m.tp + m.fp + m.fn + m.tn == m.valid
    for metric in ("delta1", "delta2"):
        rows = sorted(qm.threshold_table(p).filter(F.col("metric") == metric).collect(), key=lambda r: r.threshold)
        counts = [r["count"] for r in rows]
        assert counts == sorted(counts)
        h = qm.delta_histogram(p, metric).collect()
        assert len(h) == 10
        assert sum(r["count"] for r in h) == rows[0].total


def test_quality_report_materialized_matches(spark):
    p = fx.proposals(spark, SF_SMALL)
    lazy = qm.quality_report(p)
    mat = qm.quality_report(p, materialize=True)
    for k in ("metrics", "thresholds", "histograms"):
        assert sorted(map(tuple, lazy[k].collect())) == sorted(map(tuple, mat[k].collect()))


def test_no_value_aborts_a_job(spark):
    from pyspark.sql import functions as F

    from ballotlens.functions import clean as C
    from ballotlens.functions import text as T
    from ballotlens.operators import validate as va
    texts = ["0x" + "F" * 300, "0x1FFFFFFFFFFFFFFFFF", "0x0", "1e400", "-1e999", "NaN", "9" * 400, "0." + "0" * 400 + "1", "\t", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(C.parse_number("t").alias("v")).collect()]
    assert got[:5] == [None, 590295810358705651712.0, 0.0, None, None]
    for f in (C.clean_int, C.clean_int_excel, C.clean_float, C.clean_numeric, C.clean_numeric_sci, C.clean_bool, C.clean_bool_default, C.clean_date6,
              C.clean_percentage, C.clean_tinyint, C.coerce_int_zero, C.js_number, C.date_from_any):
        df.select(f(F.col("t")).cast("string")).collect()
    for kind in ("int", "float", "bool", "date", "string"):
        df.select(va.type_ok(F.col("t"), kind), va.fits(F.col("t"), kind)).collect()
    nums = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (-1e40,), (0.125,)], "x double")
    assert [r[0] for r in nums.select(T.percent_text("x")).collect()] == ["-", "-", "-", "-", "12.50%"]
    nums.select(T.share_text("x")).collect()


def test_lists_come_in_order(spark):
    from ballotlens.operators import accounts as acc
    from ballotlens.operators import proposals as pr
    from ballotlens.plans import fixtures as fx
    from conftest import SF_SMALL
    p, a = fx.proposals(spark, SF_SMALL), fx.accounts(spark, SF_SMALL)
    o = [tuple(r) for r in pr.filter_options(p).collect()]
    assert o == sorted(o)
    names = [r.name for r in pr.issuer_list(p).collect()]
    assert names == sorted(names, key=lambda n: n.rstrip(" ").lower())
    n = [r["count"] for r in acc.type_distribution(a).collect()]
    assert n == sorted(n, reverse=True)
    f = [tuple(r) for r in acc.account_filter_options(a).collect()]
    assert f == sorted(f)


def test_hash_names_fall_back_row_by_row(spark):
    from ballotlens.operators import outreach as ot
    df = spark.createDataFrame([("a", "x", 1), ("", "b", 2), (None, None, 3), (" \t", "z", 4)], "account_hash_key string, account_id string, id int")
    assert sorted(r[0] for r in ot.distinct_hashes(df).collect()) == ["3", "a", "b"]
