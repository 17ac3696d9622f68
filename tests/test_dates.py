"""Free-form dates against a table of values and against strptime."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.functions import dates as D

D5 = dt.date(2024, 1, 5)
KNOWN = {
    "2024-01-05": D5, "2024-1-5": D5, "2024/01/05": D5, "2024.1.5": D5, "20240105": D5, "1/5/2024": D5, "01-05-2024": D5, "1.5.2024": D5,
    "25/3/2024": dt.date(2024, 3, 25), "13-12-2024": dt.date(2024, 12, 13), "Jan 5, 2024": D5, "January 5, 2024": D5, "jan. 5 2024": D5, "JAN-05-2024": D5,
    "5 Jan 2024": D5, "5-Jan-2024": D5, "05JAN 2024": D5, "5th of January, 2024": D5, "2024 Jan 5": D5, "2024-jan-05": D5, "Jan 2024": dt.date(2024, 1, 1),
    "Sept 3, 2023": dt.date(2023, 9, 3), "Friday, January 5, 2024": D5, "Fri Jan 5 2024": D5, "2024-01-05 10:30": D5, "2024-01-05T10:30:00Z": D5,
    "2024-01-05 10:30:00.123+02:00": D5, "1/5/2024 3:07 PM": D5, " \t2024-01-05\n": D5, "Jan 5, 2024 11:59:59 pm": D5, "29/2/2024": dt.date(2024, 2, 29),
    "45292": None, "2024-01-05 junk": None, "junk 2024-01-05": None, "5/13/25": None, "13/13/2024": None, "2024-02-30": None, "2023-2-29": None, "0000-01-01": None,
    "12024-01-05": None, "null": None, "": None, "  ": None, None: None, "May": None, "5 2024": None, "2024": None, "1-5/2024": None, "20241305": None, "Jan 32, 2024": None,
    "Maybe 5, 2024": None, "10:30": None, "-2024-01-05": None, "2024-01-05-": None, "32/1/2024": None,
}


def test_known_values(spark):
    df = spark.createDataFrame([(k,) for k in KNOWN], "t string")
    got = {r.t: r.d for r in df.select("t", C.date_from_any("t").alias("d")).collect()}
    assert got == KNOWN
    read = {r.t: r.x for r in df.select("t", D.layout_of("t").alias("x")).collect()}
    assert all(read[k] is not None for k, v in KNOWN.items() if v) and read["45292"] is None


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%B %d, %Y", "%d %b %Y", "%A, %B %d, %Y", "%b-%d-%Y", "%Y/%m/%d %H:%M:%S", "%d-%B-%Y"])
def test_as_strptime(spark, form):
    r = random.Random(form)
    days = [dt.datetime(1900, 1, 1) + dt.timedelta(seconds=r.randrange(86400 * 80_000)) for _ in range(300)]
    df = spark.createDataFrame([(d.strftime(form), d.date()) for d in days], "t string, want date")
    assert df.filter(~D.free_date("t").eqNullSafe(F.col("want"))).collect() == []


def test_typed_columns(spark):
    r = spark.sql("SELECT DATE'2024-01-05' AS d, TIMESTAMP'2024-01-05 23:59:59.5' AS t, CAST(NULL AS DATE) AS n").select(*(C.date_from_any(c) for c in "dtn")).first()
    assert tuple(r) == (D5, D5, None)


def test_layouts_of_a_column(spark):
    df = spark.createDataFrame([("Jan 5, 2024",), ("March 15, 2024",), ("Mar 45, 2024",), ("1/5/2024",), ("25/3/2024",), ("x1",), (None,), (" ",)], "t string")
    got = {(r.shape, r.layout, r["values"], r.dates) for r in D.date_layouts(df, "t").collect()}
    assert got == {("Mon 9, 9999", "name day year", 1, 1), ("Mon 99, 9999", "name day year", 2, 1), ("9/9/9999", "month-day-year", 1, 1), ("99/9/9999", "month-day-year", 1, 1), ("x9", None, 1, 0)}
    assert [r.shape for r in D.undated_shapes(df, "t").collect()] == ["Mon 99, 9999", "x9"]
