"""Free-form dates by the layout of their shape.

A value's shape is its text with digits as ``9`` and month and weekday names as
``Mon`` and ``Day``; few shapes stand for all values of a column.  A shape
decides the layout, so a value is read by one guarded pattern, not by trying
parser after parser.  Years have four digits; of two numbers before the year
the first is the month unless it is over 12; a weekday before and a time of day
after the date are passed over; a month without a day is its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.functions.text import PY_WS

# English names
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _names(full: tuple[str, ...], short: int = 3) -> str:
    """Whole names or their first letters (``sept`` too), in any case."""
    other = ["sept"] if "september" in full else ["tues", "thur", "thurs"]
    return "(?i:" + "|".join([*full, *other, *(n[:short] for n in full)]) + ")"


_MON, _DAY = _names(MONTHS), _names(WEEKDAYS)
_D, _Y = "([0-9]{1,2})", "([0-9]{4})"
_NTH = "(?:st|nd|rd|th)?"
_TIME = "(?:T| +)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?"

# layout, pattern and its groups for year, first number and second number (or
# month name and day); patterns are disjoint but for numbers before the year
LAYOUTS = (
    ("year-month-day", f"^{_Y}(?:-{_D}-{_D}|/{_D}/{_D}|[.]{_D}[.]{_D})$"),
    ("yearmonthday", "^([0-9]{4})([0-9]{2})([0-9]{2})$"),
    ("month-day-year", f"^(?:{_D}-{_D}-|{_D}/{_D}/|{_D}[.]{_D}[.]){_Y}$"),
    ("name day year", f"^({_MON})[.]?[ /-]*{_D}{_NTH}(?:, *| +|[/-]){_Y}$"),
    ("day name year", f"^{_D}{_NTH}(?: +of)?[ /-]*({_MON})[.]?(?:, *| +|[/-]){_Y}$"),
    ("year name day", f"^{_Y}[ /-]+({_MON})[.]?[ /-]+{_D}$"),
    ("name year", f"^({_MON})[.]?,? *[ /-]?{_Y}$"),
)
_PATTERN = dict(LAYOUTS)


def _bare(text: Column) -> Column:
    """The date alone: blanks, a weekday before and a time after it removed."""
    t = F.btrim(text, F.lit(PY_WS))
    t = F.regexp_replace(t, f"^{_DAY}[.]?,? +(?=.*[0-9]{{4}})", "")
    return F.regexp_replace(t, f"(?<=[0-9]){_TIME}$", "")


def date_shape(c: Column | str) -> Column:
    """The value's shape; NULL for a blank one."""
    t = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(PY_WS))
    s = F.regexp_replace(F.regexp_replace(t, f"(?<![A-Za-z]){_DAY}(?![A-Za-z])", "Day"), f"(?<![A-Za-z]){_MON}(?![A-Za-z])", "Mon")
    return F.when(t != "", F.regexp_replace(s, "[0-9]", "9"))


def layout_of(c: Column | str) -> Column:
    """Name of the layout that reads the value; NULL if none does."""
    t = _bare(F.col(c) if isinstance(c, str) else c)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LAYOUTS):
        out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _month(name: Column) -> Column:
    return F.lpad(((F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int").cast("string"), 2, "0")


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when((y != "0000") & m.between("01", "12"), text.try_cast("date"))


def free_date(c: Column | str) -> Column:
    """The date that the text says; NULL where no layout reads it."""
    t = _bare(F.col(c) if isinstance(c, str) else c)

    def part(layout: str, *groups: int) -> Column:
        p = _PATTERN[layout]
        return F.lpad(F.concat(*(F.regexp_extract(t, p, g) for g in groups)), 2, "0")    # one of them holds the text

    def full(layout: str, group: int) -> Column:
        return F.regexp_extract(t, _PATTERN[layout], group)

    a, b, y = part("month-day-year", 1, 3, 5), part("month-day-year", 2, 4, 6), full("month-day-year", 7)
    first = a <= F.lit("12")
    read = {
        "year-month-day": _date(full("year-month-day", 1), part("year-month-day", 2, 4, 6), part("year-month-day", 3, 5, 7)),
        "yearmonthday": _date(full("yearmonthday", 1), full("yearmonthday", 2), full("yearmonthday", 3)),
        "month-day-year": F.when(first, _date(y, a, b)).otherwise(_date(y, b, a)),
        "name day year": _date(full("name day year", 3), _month(full("name day year", 1)), part("name day year", 2)),
        "day name year": _date(full("day name year", 3), _month(full("day name year", 2)), part("day name year", 1)),
        "year name day": _date(full("year name day", 1), _month(full("year name day", 2)), part("year name day", 3)),
        "name year": _date(full("name year", 2), _month(full("name year", 1)), F.lit("01")),
    }
    out = F.lit(None).cast("date")
    for name, pattern in reversed(LAYOUTS):
        out = F.when(t.rlike(pattern), read[name]).otherwise(out)
    return out


def date_layouts(df: DataFrame, col: str) -> DataFrame:
    """(shape, layout, values, dates): how a column writes its dates.  Values are
    counted by shape first (distinct ones are few), layouts chosen after."""
    rows = df.filter(F.col(col).isNotNull()).select(date_shape(col).alias("shape"), F.col(col).alias("v"))
    return (rows.filter(F.col("shape").isNotNull()).groupBy("shape")
            .agg(F.min(layout_of("v")).alias("layout"), F.count("*").alias("values"), F.count(free_date("v")).alias("dates")))


def undated_shapes(df: DataFrame, col: str) -> DataFrame:
    """The shapes with values that no layout reads, most frequent first."""
    return date_layouts(df, col).filter(F.col("dates") < F.col("values")).orderBy(F.desc(F.col("values") - F.col("dates")), "shape")
