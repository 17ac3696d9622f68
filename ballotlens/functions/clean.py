"""Cleaning functions for raw text columns: Column -> Column, all JVM-side.

Spark 4 runs with ANSI mode on, so every conversion goes through ``try_cast``
/ ``try_to_date`` and a bad value becomes NULL instead of failing the job.
The parsing rules are those of the loaders the operators come from (Python's
``float`` / ``int`` / ``strptime``, the browser's ``Number``); where Spark's
own cast is more lenient (it takes ``'1d'``, ``'0x1F'`` is not a number to it)
the text is first checked against an explicit number pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.functions.dates import free_date
from ballotlens.functions.text import JS_WS, PY_WS

# fixed values: accepted spellings of booleans / missing values
TRUE_WORDS = ("TRUE", "1", "YES", "Y")
FALSE_WORDS = ("FALSE", "0", "NO", "N")
TRUE_WORDS_TF = ("TRUE", "T", "1", "YES", "Y")
FALSE_WORDS_TF = ("FALSE", "F", "0", "NO", "N")
EXCEL_TRUE_WORDS = ("true", "1", "yes", "y")
NULL_TOKENS = ("nan", "None")

# fixed values: date layouts tried in order (first match wins)
DATE_FORMATS_6 = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy")
DATE_FORMATS_3 = ("M/d/yyyy", "yyyy-M-d", "M-d-yyyy")

_DEC_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT_NUMBER = r"^[+-]?[0-9]+$"
_SPECIAL = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan", "+nan", "-nan")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Python ``str.strip()``: whitespace on both ends (character-set trim)."""
    return F.btrim(_c(c), F.lit(PY_WS))


def is_blank(c: Column | str) -> Column:
    """``not value or value.strip() == ''`` (NULL counts as blank)."""
    x = _c(c)
    return x.isNull() | (strip(x) == "")


def py_float(c: Column | str, allow_special: bool = True) -> Column:
    """Python ``float(text)``: surrounding whitespace, sign, exponent, '_'
    between digits, and (optionally) inf / nan; anything else -> NULL."""
    x = _c(c)
    # fast path on the raw text: made only of digits, sign, point and exponent
    # letters, Java's double parser accepts exactly what Python's float accepts,
    # so a plain cast decides; strip + regex run only for the rest
    fast = F.when(F.translate(x, "0123456789+-.eE", "") == "", x.try_cast("double"))
    t0 = strip(x)
    t = F.when(t0.contains("_"), F.regexp_replace(t0, "(?<=[0-9])_(?=[0-9])", "")).otherwise(t0)
    ok = t.rlike(_DEC_NUMBER)
    if allow_special:
        ok = ok | F.lower(t).isin(*_SPECIAL)
    return F.coalesce(fast, F.when(ok, t.try_cast("double")))


def finite(x: Column) -> Column:
    """NULL for NaN / +-infinity (NaN compares above every number in Spark,
    so one test covers all three; ``x`` sits in the first predicate, where
    Spark evaluates a shared subexpression once)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _trunc_to_long(d: Column) -> Column:
    """Truncate toward zero; NaN, infinities and overflow give NULL (try_cast)."""
    return d.try_cast("bigint")


def _is_minus_one(x: Column) -> Column:
    """strip(x) == '-1', paying for the strip only when '-1' occurs at all."""
    return (x == "-1") | (x.contains("-1") & (strip(x) == "-1"))


# --------------------------------------------------------------- C1 / C2
def clean_int(c: Column | str, sentinel: bool = True) -> Column:
    """Blank or exactly '-1' (after strip) -> NULL; else int(float(s)),
    truncating toward zero; bad, NaN or infinite -> NULL."""
    x = _c(c)
    out = _trunc_to_long(py_float(x))   # blank text never parses, so it is NULL already
    return F.when(~_is_minus_one(x), out) if sentinel else out


def clean_int_excel(c: Column | str) -> Column:
    """As ``clean_int`` but -1 is kept."""
    return clean_int(c, sentinel=False)


# --------------------------------------------------------------------- C3
def clean_float(c: Column | str) -> Column:
    """Blank / bad -> NULL; NaN and infinities -> NULL too."""
    return finite(py_float(c))   # blank text never parses


# --------------------------------------------------------------------- C4
def clean_numeric(c: Column | str, places: int = 4) -> Column:
    """Blank or 'null' (any case) -> NULL; commas dropped; exact decimal
    rounded (half-up) to ``places``."""
    x = _c(c)
    t = strip(F.regexp_replace(x, ",", ""))
    ok = t.rlike(_DEC_NUMBER)
    dec = F.round(t.try_cast("decimal(38,10)"), places).cast(f"decimal(38,{places})")
    return F.when(~is_blank(x) & (F.lower(strip(x)) != "null") & ok, dec)


# --------------------------------------------------------------------- C5
def clean_numeric_sci(c: Column | str, places: int | None = None) -> Column:
    """Text with an exponent sign (E+, E-, e+, e-) or a '.' parses as a float
    (rounded to ``places`` if given); otherwise it must be a whole number."""
    x = _c(c)
    as_float = py_float(x)
    if places is not None:
        as_float = F.bround(as_float, places)
    as_int = F.when(F.regexp_replace(strip(x), "(?<=[0-9])_(?=[0-9])", "").rlike(_INT_NUMBER),
                    F.regexp_replace(strip(x), "_", "").try_cast("bigint").cast("double"))
    has_exp = x.contains("E+") | x.contains("E-") | x.contains("e+") | x.contains("e-")
    return F.when(is_blank(x), F.lit(None).cast("double")) \
        .when(has_exp | x.contains("."), as_float).otherwise(as_int)


# --------------------------------------------------------------- C6 - C9
def clean_bool(c: Column | str, true_words: Sequence[str] = TRUE_WORDS,
               false_words: Sequence[str] = FALSE_WORDS) -> Column:
    """Upper-cased, stripped text among the true / false spellings; else NULL."""
    x = _c(c)
    u = F.upper(strip(x))
    # exact spellings first (the common case), then the stripped, upper-cased text
    return F.when(x.isin(*true_words), F.lit(True)).when(x.isin(*false_words), F.lit(False)) \
        .when(u.isin(*true_words), F.lit(True)).when(u.isin(*false_words), F.lit(False))


def clean_bool_tf(c: Column | str) -> Column:
    """As ``clean_bool`` plus T / F."""
    return clean_bool(c, TRUE_WORDS_TF, FALSE_WORDS_TF)


def clean_bool_excel(c: Column | str) -> Column:
    """Text (lower-cased, not stripped) among true/1/yes/y -> TRUE, any
    other text -> FALSE; NULL stays NULL."""
    x = _c(c)
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(x).isin(*EXCEL_TRUE_WORDS))


def clean_bool_excel_number(c: Column | str) -> Column:
    """C7 for numeric cells: bool(int(v))."""
    x = _c(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("boolean")).otherwise(_trunc_to_long(x) != 0)


def clean_bool_default(c: Column | str) -> Column:
    """Blank -> FALSE; else bool(int(s)).  Text that is not a whole
    number (a row error for the source loader) -> NULL."""
    x = _c(c)
    n = F.when(strip(x).rlike(_INT_NUMBER), strip(x).try_cast("bigint"))
    return F.when(is_blank(x), F.lit(False)).otherwise(n != 0)


# -------------------------------------------------------------- C10 - C13
def _layout_regex(fmt: str) -> str:
    """Shape of a date layout ('yyyy-M-d' -> 4 digits, 1-2 digits, 1-2 digits)."""
    out = fmt.replace("yyyy", "Y").replace("M", "D").replace("d", "D")
    out = "".join("[0-9]{4}" if ch == "Y" else "[0-9]{1,2}" if ch == "D" else "\\" + ch for ch in out)
    return f"^{out}$"


def _first_date(t: Column, formats: Sequence[str]) -> Column:
    """First layout that parses.  Each parse is guarded by the layout's shape:
    a failed date parse is expensive (an exception per value), a regex is not,
    and the guard also rejects years of other than four digits."""
    return F.coalesce(*[F.when(t.rlike(_layout_regex(f)), F.try_to_date(t, f)) for f in formats])


def clean_date6(c: Column | str) -> Column:
    """Stripped; blank / 'null' -> NULL; first of six layouts that parses
    (month-first before day-first); two-digit years do not parse."""
    x = _c(c)
    t = strip(x)
    return F.when(~is_blank(x) & (F.lower(t) != "null"), _first_date(t, DATE_FORMATS_6))


def clean_date3(c: Column | str) -> Column:
    x = _c(c)
    return F.when(~is_blank(x), _first_date(strip(x), DATE_FORMATS_3))


def clean_date_mdy(c: Column | str) -> Column:
    """Only M/D/YYYY, on the untrimmed text."""
    x = _c(c)
    return F.when(~is_blank(x), _first_date(x, ["M/d/yyyy"]))


def date_from_any(c: Column | str) -> Column:
    """Text in any layout of ``functions.dates``: years of four digits, month
    names, a time of day after the date.  Date and timestamp columns are text to
    it, in ISO form."""
    return free_date(_c(c).cast("string"))


# -------------------------------------------------------------- C14 / C15
def clean_percentage(c: Column | str) -> Column:
    """Keep only digits, '.', '-'; then a float; empty / bad -> NULL (not /100)."""
    x = _c(c)
    kept = F.regexp_replace(x, "[^0-9.-]", "")
    return F.when(kept != "", finite(py_float(kept, allow_special=False)))


def clean_tinyint(c: Column | str) -> Column:
    """Blank / bad -> NULL; int(float(s)) clamped to 0..255."""
    n = _trunc_to_long(py_float(c))
    return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), n)).cast("int"))


# -------------------------------------------------------------- C16 - C18
def clean_blank(c: Column | str) -> Column:
    """'' -> NULL (no trimming)."""
    return F.nullif(_c(c), F.lit(""))


def clean_director_name(c: Column | str) -> Column:
    x = _c(c)
    return F.when(~x.isin("", "-1"), x)


def clean_truncate(c: Column | str, n: int = 500) -> Column:
    """Blank after strip -> NULL, else the first ``n`` characters."""
    x = _c(c)
    return F.when(~is_blank(x), F.substring(x, 1, n))


def _hex_value(t: Column) -> Column:
    """Value of a 0x literal of any length, digit by digit in doubles (exact up
    to 53 bits; beyond the range of doubles: infinity)."""
    digits = F.split(F.regexp_replace(F.lower(t), "^0x0*", ""), "")
    places = F.filter(digits, lambda d: d != "")
    return F.aggregate(places, F.lit(0.0), lambda a, d: a * 16.0 + (F.instr(F.lit("0123456789abcdef"), d) - 1).cast("double"))


# --------------------------------------------------------------------- C19
def parse_number(c: Column | str) -> Column:
    """Browser rule: trim, drop commas, '' -> NULL, decimal or 0x-hex number,
    non-finite -> NULL."""
    t = F.regexp_replace(F.btrim(_c(c), F.lit(JS_WS)), ",", "")
    hexv = F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), _hex_value(t))
    dec = F.when(t.rlike(_DEC_NUMBER), t.try_cast("double"))
    return F.when(t != "", finite(F.coalesce(dec, hexv)))


# --------------------------------------------------------------------- C20
def coerce_int_zero(c: Column | str) -> Column:
    """Numeric coerce, round half-even, NULL / NaN / bad -> 0."""
    x = _c(c)
    d = x.cast("string")
    v = finite(py_float(d))
    return F.coalesce(F.bround(v, 0).try_cast("bigint"), F.lit(0).cast("bigint"))


# --------------------------------------------------------------- C21 / C22
def blank_text_tokens(c: Column | str) -> Column:
    """'nan', 'None' and NULL -> ''."""
    x = _c(c)
    return F.when(x.isNull() | x.isin(*NULL_TOKENS), F.lit("")).otherwise(x)


def drop_blank_keys(df: DataFrame, col: str = "account_hash_key") -> DataFrame:
    """Normalise the key's missing-value tokens and drop rows whose key is blank."""
    out = df.withColumn(col, blank_text_tokens(col))
    return out.filter(strip(col) != "")


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """NaN, +inf, -inf -> NULL in every float / double column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(finite(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --------------------------------------------------------------------- C27
def typed_accounts(df: DataFrame, shares_as: str = "float") -> DataFrame:
    """Pass-through typing of account rows; NULL is kept.  ``shares_as`` is
    'float' or 'int' (truncated), the two variants of the source loaders."""
    ints = ("proposal_master_skey", "director_master_skey", "rank_of_shareholding", "Target_encoded",
            "row_index")
    floats = [c for c in df.columns if c.startswith("score_model") or c.startswith("prediction_model")]
    out = []
    for c in df.columns:
        if c in ints:
            out.append(_trunc_to_long(F.col(c).cast("double")).alias(c))
        elif c in floats:
            out.append(finite(F.col(c).cast("double")).alias(c))
        elif c == "shares_summable":
            v = finite(F.col(c).cast("double"))
            out.append((v if shares_as == "float" else _trunc_to_long(v)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------ browser Number()
def js_decimal(c: Column | str) -> Column:
    """The browser's ``Number(text)`` but for hex literals: trimmed decimal,
    +-Infinity; '' -> 0; anything else NULL (NaN)."""
    t = F.btrim(_c(c).cast("string"), F.lit(JS_WS))
    dec = F.when(t.rlike(_DEC_NUMBER), t.try_cast("double"))
    inf = F.when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))) \
        .when(t == "-Infinity", F.lit(float("-inf")))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(dec, inf))


def js_number(c: Column | str) -> Column:
    """The browser's ``Number(text)``, 0x-hex literals too."""
    t = F.btrim(_c(c).cast("string"), F.lit(JS_WS))
    return F.coalesce(js_decimal(c), F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), _hex_value(t)))


# ------------------------------------------------------------ type-aware forms
def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def as_long(c: Column | str, dtype: T.DataType, sentinel: bool = False) -> Column:
    """Whole number from a typed or text column: numbers are truncated
    directly (no text round trip), text goes through ``clean_int``."""
    x = _c(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = x.cast("bigint")
        return F.when(out != -1, out) if sentinel else out
    if _is_numeric(dtype):
        out = _trunc_to_long(x.cast("double"))
        return F.when(out != -1, out) if sentinel else out
    return clean_int(x.cast("string"), sentinel=sentinel)


def as_double(c: Column | str, dtype: T.DataType) -> Column:
    """Finite double from a typed or text column (NaN / infinities -> NULL)."""
    x = _c(c)
    if _is_numeric(dtype):
        return finite(x.cast("double"))
    return clean_float(x.cast("string"))
