"""Property tests: cleaning rules against Python's own parsers on generated text,
and the two-row smoke set (delete by pattern, score statistics)."""
import datetime as dt
import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.operators import accounts as acc
from ballotlens.operators import outreach as ot

ALPHABET = "0123456789+-.eE _ax,/\t"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=8), min_size=50, max_size=120)


def py_int(s):
    """int(float(s)) with blank / exactly '-1' -> None; failures -> None.  The
    target column is BIGINT, so a value outside its range is None too (the
    database would reject it)."""
    if s is None or s.strip() == "" or s.strip() == "-1":
        return None
    try:
        v = int(float(s))
    except (ValueError, OverflowError):
        return None
    return v if -(2 ** 63) <= v < 2 ** 63 else None


def py_float(s):
    if s is None or s.strip() == "":
        return None
    try:
        v = float(s)
    except ValueError:
        return None
    return v if math.isfinite(v) else None


def py_bool(s):
    if s is None or s.strip() == "":
        return None
    u = s.upper().strip()
    return True if u in ("TRUE", "1", "YES", "Y") else False if u in ("FALSE", "0", "NO", "N") else None


@settings(max_examples=8, deadline=None)
@given(texts)
def test_numbers_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", C.clean_int("v").alias("a"), C.clean_float("v").alias("b")).orderBy("i").collect()
    for v, r in zip(values, rows):
        assert r.a == py_int(v), (v, r.a)
        assert r.b == py_float(v), (v, r.b)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["TRUE", " yes", "n", "0", "1 ", "t", "F", "", " ", "No", "maybe", "y"]),
                min_size=20, max_size=40))
def test_bools_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.o for r in df.select("i", C.clean_bool("v").alias("o")).orderBy("i").collect()]
    assert got == [py_bool(v) for v in values]


def py_date6(s):
    if s is None or s.strip() == "" or s.strip().lower() == "null":
        return None
    for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y"):
        try:
            return dt.datetime.strptime(s.strip(), f).date()
        except ValueError:
            continue
    return None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1990, 2030), st.integers(1, 31), st.integers(1, 31),
                          st.sampled_from(["{y}-{a}-{b}", "{a}/{b}/{y}", "{y}/{a}/{b}", "{a}-{b}-{y}", " {a}/{b}/{y} ",
                                           "{a}/{b}/{yy}"])), min_size=20, max_size=40))
def test_dates_match_python(spark, parts):
    values = [f.format(y=y, a=a, b=b, yy=y % 100) for y, a, b, f in parts]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.o for r in df.select("i", C.clean_date6("v").alias("o")).orderBy("i").collect()]
    assert got == [py_date6(v) for v in values]


SMOKE = [("test_hash_1", 1, 1, "I", 1000.0, 1, 0.5, 0.6, 1), ("test_hash_2", 2, 2, "R", 2000.0, 2, 0.7, 0.8, 0)]
SMOKE_SCHEMA = ("account_hash_key string, proposal_master_skey long, director_master_skey long, account_type string, "
                "shares_summable double, rank_of_shareholding long, score_model2 double, prediction_model2 double, "
                "Target_encoded long")


def test_smoke_rows_stats_and_cleanup(spark):
    df = spark.createDataFrame(SMOKE, SMOKE_SCHEMA).withColumn("is_voted", F.lit(0))
    s = {r.measure: r for r in acc.score_stats(df, "score_model2", "prediction_model2").collect()}
    assert math.isclose(s["score"].avg, 0.6) and math.isclose(s["score"].std, statistics.pstdev([0.5, 0.7]))
    assert (s["prediction"].min, s["prediction"].max) == (0.6, 0.8)
    assert ot.delete_where_like(df, "account_hash_key", "test_hash_%").count() == 0
