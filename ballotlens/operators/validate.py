"""Validation and data-quality reports: column diffs, type checks, fit checks,
row counts, completeness and load reports.  Every report is a DataFrame
computed in one pass; only ``enforce_error_budget`` pulls one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballotlens.functions import clean as C
from ballotlens.functions.text import JS_WS
from ballotlens.operators.proposals import ci_key
from ballotlens.schema import ACCOUNT_FILE_COLUMNS, ACCOUNT_TYPES, OLD_FORMAT_COLUMNS


# ---------------------------------------------------------------------- V1
def column_diff(spark: SparkSession, df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(kind, column, position): missing columns in schema order, extra ones in file order."""
    cols = list(df.columns)
    rows = [("missing", c, i) for i, c in enumerate(expected) if c not in cols]
    rows += [("extra", c, i) for i, c in enumerate(cols) if c not in expected]
    return spark.createDataFrame(rows, "kind string, column string, position int")


def column_fill(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(kind, column, position, filled): every expected or found column, whether
    it is there (ok, missing, extra), and how many of its values are neither
    NULL nor blank: one pass over the rows, whatever the columns."""
    cols = list(df.columns)
    names = [*expected, *(c for c in cols if c not in expected)]
    kinds = ["missing" if c not in cols else "ok" if c in expected else "extra" for c in names]
    at = [expected.index(c) if c in expected else cols.index(c) for c in names]

    def filled(c):
        return F.count_if(F.btrim(F.col(f"`{c}`").cast("string")) != "") if c in cols else F.sum(F.lit(0))

    wide = df.agg(*(F.coalesce(filled(c), F.lit(0)).cast("bigint").alias(f"n{i}") for i, c in enumerate(names)))
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.lit(a).alias("position"), F.col(f"n{i}").alias("filled"))
            for i, (k, c, a) in enumerate(zip(kinds, names, at, strict=True))]
    return wide.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------- V2
def _finite_number(v: Column) -> Column:
    """Whether the browser's ``Number`` of the text is finite: hex literals by
    their digits (256 of them reach the range of doubles), others by value."""
    t = F.btrim(v, F.lit(JS_WS))
    hexa = t.rlike("^0[xX][0-9a-fA-F]+$")
    whole = t.rlike("^0[xX]0*[0-9a-fA-F]{1,256}$") & ~t.rlike("^0[xX]0*[fF]{13}[89a-fA-F][0-9a-fA-F]{242}$")
    n = F.when(~hexa, C.js_decimal(v))
    return F.when(hexa, whole).otherwise(F.coalesce(n.isNotNull() & (F.abs(n) != float("inf")), F.lit(False)))


def _whole_number(v: Column) -> Column:
    t = F.btrim(v, F.lit(JS_WS))
    n = C.js_decimal(v)
    return F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), _finite_number(v)).otherwise(F.coalesce((F.abs(n) != float("inf")) & (F.floor(n) == n), F.lit(False)))


def type_ok(value: Column, kind: str) -> Column:
    """The upload validator's check of one raw value; NULL / '' always pass."""
    v = value.cast("string")
    if kind == "int":
        ok = v.rlike(r"^-?\d+$") | _whole_number(v)
    elif kind == "float":
        ok = _finite_number(v)
    elif kind == "bool":
        ok = v.isin("0", "1", "true", "false")
    elif kind == "date":
        ok = C.date_from_any(v).isNotNull()
    else:
        ok = F.lit(True)
    return v.isNull() | (v == "") | ok


def type_violations(df: DataFrame, checks: Mapping[str, str], order_col: str, n: int | None = None,
                    row_offset: int = 2) -> DataFrame:
    """(row key, column, expected, got) for every failing check.

    All rows are checked.  With ``n`` (the upload validator samples 10) only
    the first ``n`` rows by ``order_col`` are, and the result adds ``row``: the line in the file (1-based
    position + ``row_offset - 1``, i.e. header = line 1).  Numbering only the
    ``n``-row sample keeps that window tiny; without ``n``
    rows are named by ``order_col`` only (no global numbering).  Columns absent
    from ``df`` are skipped (V1 reports them)."""
    present = [(c, k) for c, k in checks.items() if c in df.columns]
    items = [F.when(~type_ok(F.col(c), k), F.struct(F.lit(c).alias("column"), F.lit(k).alias("expected"),
                                                     F.col(c).cast("string").alias("got")))
             for c, k in present]
    bad = F.filter(F.array(*items), lambda x: x.isNotNull())
    if n is None:
        out = df.select(F.col(order_col), F.explode(bad).alias("v"))
        return out.select(order_col, "v.column", "v.expected", "v.got")
    sample = df.orderBy(F.col(order_col).asc_nulls_first()).limit(n)
    w = Window.orderBy(F.col(order_col).asc_nulls_first())
    numbered = sample.withColumn("row", (F.row_number().over(w) + (row_offset - 1)).cast("int"))
    out = numbered.select("row", F.col(order_col), F.explode(bad).alias("v"))
    return out.select("row", order_col, "v.column", "v.expected", "v.got")


def type_violation_counts(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """All rows: failing values per column."""
    present = [(c, k) for c, k in checks.items() if c in df.columns]
    aggs = [F.count_if(~type_ok(F.col(c), k)).cast("bigint").alias(c) for c, k in present]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', '{k}', `{c}`" for c, k in present)
    return wide.select(F.expr(f"stack({len(present)}, {args}) AS (column, expected, violations)"))


# ---------------------------------------------------------------------- V3
_INT_MIN, _INT_MAX = -(2 ** 31), 2 ** 31 - 1


def fits(value: Column, kind: str, varchar: int = 255) -> Column:
    """Would the raw value fit the trial table's column type?"""
    v = value.cast("string")
    blank = v.isNull() | (v == "")
    if kind == "int":
        d = C.py_float(v)
        ok = d.isNotNull() & (F.floor(d) == d) & d.between(_INT_MIN, _INT_MAX)
    elif kind == "float":
        d = C.py_float(v, allow_special=False)
        ok = d.isNotNull() & (F.abs(d) < 1e14)
    elif kind == "bool":
        ok = v.isin("0", "1", "true", "false")
    elif kind == "date":
        ok = C.date_from_any(v).isNotNull()
    else:
        ok = F.length(v) <= varchar
    return blank | ok


def fit_violations(df: DataFrame, checks: Mapping[str, str], varchar: int = 255) -> DataFrame:
    """Per column: values that would not fit INT / DECIMAL(20,6) / DATE /
    VARCHAR(n), and the smallest such value as an example."""
    present = [(c, k) for c, k in checks.items() if c in df.columns]
    aggs = []
    for c, k in present:
        bad = ~fits(F.col(c), k, varchar)
        aggs += [F.count_if(bad).cast("bigint").alias(f"n_{c}"), F.min(F.when(bad, F.col(c).cast("string"))).alias(f"x_{c}")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', '{k}', `n_{c}`, `x_{c}`" for c, k in present)
    return wide.select(F.expr(f"stack({len(present)}, {args}) AS (column, expected, violations, example)"))


# ---------------------------------------------------------------------- V4
def verify_dataset(proposals: DataFrame, dataset_col: str | None = None, accent_insensitive: bool = False) -> DataFrame:
    """Rows, distinct non-NULL issuers (case-insensitive) and meeting date
    range, per dataset (or overall)."""
    cols = set(proposals.columns)
    dates = [F.col(c) for c in ("mt_date", "meeting_date") if c in cols]
    d = F.coalesce(*dates) if len(dates) > 1 else (dates[0] if dates else F.lit(None).cast("date"))
    g = [dataset_col] if dataset_col else []
    return proposals.groupBy(*g).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_distinct(ci_key("issuer_name", accent_insensitive)).cast("bigint").alias("issuers"),
        F.min(d).alias("first_meeting"), F.max(d).alias("last_meeting"))


def verify_datasets(spark: SparkSession, proposals: DataFrame, dataset_col: str,
                    expected: Sequence[str]) -> DataFrame:
    """``verify_dataset`` for a list of expected datasets, with a ``present``
    flag: a dataset without rows (its table missing) still gets a row.  The
    expected list is the caller's (a handful of names), joined to the
    per-dataset aggregate."""
    stats = verify_dataset(proposals, dataset_col).withColumnRenamed(dataset_col, "dataset")
    names = spark.createDataFrame([(n,) for n in expected], "dataset string")
    j = names.join(stats, "dataset", "left")
    return j.select("dataset", F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"),
                    F.coalesce(F.col("issuers"), F.lit(0)).cast("bigint").alias("issuers"),
                    "first_meeting", "last_meeting", F.col("rows").isNotNull().alias("present"))


# ---------------------------------------------------------------------- V5
def format_check(df: DataFrame, first_rows: int | None = None, order_col: str | None = None) -> DataFrame:
    """Account file format report: exact column order, old layout, bad account
    types, predictions not 0/1, empty hashes (optionally first rows only)."""
    cols = list(df.columns)
    data_cols = [c for c in cols if c not in OLD_FORMAT_COLUMNS]
    order_ok = data_cols == list(ACCOUNT_FILE_COLUMNS)
    old = any(c in cols for c in OLD_FORMAT_COLUMNS)
    src = df
    if first_rows is not None:
        src = df.orderBy(order_col).limit(first_rows) if order_col else df.limit(first_rows)
    pred = next((c for c in cols if c.startswith("prediction_model")), None)
    bad_pred = (~F.col(pred).cast("string").isin("0", "1", "0.0", "1.0")) if pred else F.lit(False)
    has_type = "account_type" in cols
    has_hash = "account_hash_key" in cols
    return src.agg(
        F.lit(order_ok).alias("columns_in_order"), F.lit(old).alias("old_format"),
        F.count(F.lit(1)).cast("bigint").alias("rows_checked"),
        F.count_if(~F.col("account_type").isin(*ACCOUNT_TYPES) if has_type else F.lit(False))
        .cast("bigint").alias("bad_account_type"),
        F.count_if(F.coalesce(bad_pred, F.lit(True))).cast("bigint").alias("bad_prediction"),
        F.count_if(F.coalesce(F.trim(F.col("account_hash_key")) == "", F.lit(True)) if has_hash else F.lit(False))
        .cast("bigint").alias("empty_hash"))


# ---------------------------------------------------------------------- V6
def load_completeness(source: DataFrame, target: DataFrame) -> DataFrame:
    s = source.agg(F.count(F.lit(1)).alias("total"))
    t = target.agg(F.count(F.lit(1))).scalar()
    return s.select(F.col("total").cast("bigint").alias("total"), t.cast("bigint").alias("current"),
                    F.greatest(F.col("total") - t, F.lit(0)).cast("bigint").alias("remaining"),
                    (t >= F.col("total")).alias("complete"))


# ---------------------------------------------------------------------- V7
def load_report(rows: DataFrame, errors_col: str = "_errors", failed_col: str | None = None) -> DataFrame:
    """Rows imported, rows that can't be inserted (``failed_col``; none where
    the table takes NULL in every field), rows with a cell that was set to NULL
    because it didn't parse, and how many such cells."""
    failed = F.col(failed_col) if failed_col else F.lit(False)
    n = F.size(F.col(errors_col))
    return rows.agg(F.count_if(~failed).cast("bigint").alias("imported"), F.count_if(failed).cast("bigint").alias("errors"),
                    F.count_if(~failed & (n > 0)).cast("bigint").alias("rows_with_bad_cells"),
                    F.coalesce(F.sum(F.when(~failed, n)), F.lit(0)).cast("bigint").alias("bad_cells"))


def cell_errors(rows: DataFrame, errors_col: str = "_errors") -> DataFrame:
    """Cells set to NULL, per field."""
    return rows.select(F.explode(errors_col).alias("field")).groupBy("field").agg(F.count(F.lit(1)).cast("bigint").alias("bad_cells"))


def split_rejects(rows: DataFrame, failed_col: str = "_failed") -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows that can't be)."""
    return rows.filter(~F.col(failed_col)).drop(failed_col), rows.filter(F.col(failed_col))


def enforce_error_budget(report: DataFrame, max_errors: int | None = None) -> dict:
    """Pull the one-row report; stop the load when more rows failed than
    ``max_errors`` (None: no limit)."""
    r = report.first().asDict()
    if max_errors is not None and r["errors"] > max_errors:
        raise RuntimeError(f"load stopped: {r['errors']} error rows > {max_errors}")
    return r


# ---------------------------------------------------------------------- V8
def table_counts(accounts: DataFrame, dataset_col: str = "dataset", voted_col: str = "is_voted") -> DataFrame:
    """Rows per dataset and table (voted / unvoted), plus a total row per dataset."""
    t = F.when(F.col(voted_col) == 1, "account_voted").otherwise("account_unvoted")
    g = accounts.groupBy(F.col(dataset_col).alias("dataset"), t.alias("table")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"))
    # totals from the grouped rows: the accounts are read once
    both = g.groupingSets([["dataset", "table"], ["dataset"]], "dataset", "table").agg(
        F.sum("rows").cast("bigint").alias("rows"), F.grouping("table").alias("is_total"))
    return both.select("dataset", F.when(F.col("is_total") == 1, F.lit("total")).otherwise(F.col("table")).alias("table"), "rows")


# --------------------------------------------------------------------- A25
def table_inventory(spark: SparkSession, tables: Mapping[str, str], skip_pattern: str = "backup") -> DataFrame:
    """Per table: rows, files and size in MB (from the file metadata column),
    skipping tables whose name contains ``skip_pattern``."""
    files = None
    for name, path in sorted(tables.items()):
        if skip_pattern and skip_pattern in name.lower():
            continue
        # one pass a table, a row a file
        one = spark.read.parquet(path).groupBy("_metadata.file_path").agg(
            F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")).select(F.lit(name).alias("table"), "rows", "bytes")
        files = one if files is None else files.unionByName(one)
    sums = files.rollup("table").agg(F.sum("rows").cast("bigint").alias("rows"), F.count(F.lit(1)).cast("bigint").alias("files"),
                                     F.round(F.sum("bytes") / (1024 * 1024), 2).alias("size_mb"))
    return sums.withColumn("table", F.coalesce("table", F.lit("TOTAL")))


# ---------------------------------------------------------------------- H10
def varchar_violations(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Per text column with a declared length: values longer than the limit."""
    present = [(c, n) for c, n in limits.items() if c in df.columns]
    aggs = [F.count_if(F.length(F.col(c)) > n).cast("bigint").alias(c) for c, n in present]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', {n}, `{c}`" for c, n in present)
    return wide.select(F.expr(f"stack({len(present)}, {args}) AS (column, max_length, violations)"))
