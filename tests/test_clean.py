"""Cleaning rules on literal inputs; expected values follow the source loaders' rules."""
import datetime as dt

from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.functions import text as T
from ballotlens.sources import textscan


def run(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_int(spark):
    vals = ["", " ", "-1", " -1 ", "-1.0", "123.9", "-2.5", "1e3", "abc", None, "nan", "inf", "7", "1_000", "1d"]
    assert run(spark, C.clean_int, vals) == [None, None, None, None, -1, 123, -2, 1000, None, None, None, None, 7,
                                             1000, None]
    assert run(spark, C.clean_int_excel, ["-1", "-1.0"]) == [-1, -1]


def test_clean_float_and_numeric(spark):
    assert run(spark, C.clean_float, ["1.5", " 2 ", "nan", "inf", "x", ""]) == [1.5, 2.0, None, None, None, None]
    out = run(spark, C.clean_numeric, ["1,234.56789", " 0.12344 ", "NULL", "12,3x", "", "null "])
    assert [None if o is None else str(o) for o in out] == ["1234.5679", "0.1234", None, None, None, None]


def test_clean_numeric_sci(spark):
    vals = ["1.2E+05", "1e3", "2.5", "7", " 8 ", "abc", ""]
    assert run(spark, lambda c: C.clean_numeric_sci(c, 6), vals) == [120000.0, None, 2.5, 7.0, 8.0, None, None]


def test_booleans(spark):
    vals = ["TRUE", " yes ", "n", "0", "t", "F", "maybe", "", None]
    assert run(spark, C.clean_bool, vals) == [True, True, False, False, None, None, None, None, None]
    assert run(spark, C.clean_bool_tf, vals) == [True, True, False, False, True, False, None, None, None]
    assert run(spark, C.clean_bool_excel, vals) == [True, False, False, False, False, False, False, False, None]
    assert run(spark, C.clean_bool_default, ["", "1", "0", " 2 ", "x"]) == [False, True, False, True, None]


def test_dates(spark):
    vals = ["2024-1-5", "1/5/2024", "13/02/2024", "2024/02/13", "02-13-2024", "13-02-2024", " 2024-02-13 ",
            "5/13/25", "null", ""]
    d = dt.date
    assert run(spark, C.clean_date6, vals) == [d(2024, 1, 5), d(2024, 1, 5), d(2024, 2, 13), d(2024, 2, 13),
                                                d(2024, 2, 13), d(2024, 2, 13), d(2024, 2, 13), None, None, None]
    assert run(spark, C.clean_date3, ["5/13/2025", "2025-05-13", "05-13-2025", "13/5/2025"]) == \
        [d(2025, 5, 13)] * 3 + [None]
    assert run(spark, C.clean_date_mdy, ["5/13/2025", " 5/13/2025", "2025-05-13"]) == [d(2025, 5, 13), None, None]


def test_misc(spark):
    assert run(spark, C.clean_percentage, ["12.5%", "~ 7", "n/a", "--"]) == [12.5, 7.0, None, None]
    assert run(spark, C.clean_tinyint, ["300", "-5", "12.9", "x", ""]) == [255, 0, 12, None, None]
    assert run(spark, C.coerce_int_zero, ["2.5", "3.5", "-2.5", "x", None, "nan"]) == [2, 4, -2, 0, 0, 0]
    assert run(spark, C.parse_number, [" 1,234 ", "0x1F", "Infinity", "", "1e3"]) == [1234.0, 31.0, None, None, 1000.0]
    assert run(spark, C.clean_blank, ["", " ", "a"]) == [None, " ", "a"]
    assert run(spark, C.clean_director_name, ["", "-1", "Ann"]) == [None, None, "Ann"]
    assert run(spark, C.blank_text_tokens, ["nan", "None", None, "k"]) == ["", "", "", "k"]


def test_non_finite_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), float("-inf"))], "a double, b double")
    rows = C.non_finite_to_null(df).collect()
    assert [tuple(r) for r in rows] == [(None, 1.0), (None, None)]


def test_text_helpers(spark):
    long = "one two three four five six seven eight nine ten eleven"
    assert run(spark, lambda c: T.truncate_words(c, 10), [long, "  short text ", None, ""]) == [
        "one two three four five six seven eight nine ten...", "  short text ", "-", "-"]
    assert run(spark, T.percent_text, ["0.12345", None], "string") == ["12.35%", "-"]
    assert run(spark, T.share_text, ["1234567.891", None], "string") == ["1,234,567.89", "-"]
    assert run(spark, lambda c: T.row_key(None, c, F.lit(3)), ["a b", None]) == ["hash_a_b", "idx_3"]


def test_repair_text(spark):
    assert run(spark, textscan.repair_text, ["a�b\x00c", "é"]) == ["abc", "é"]
    assert run(spark, lambda c: textscan.repair_text(c, drop_non_ascii=True), ["aéb"]) == ["ab"]
