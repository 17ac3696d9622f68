"""Sinks: replace / append / copy tables, CSV export, load-if-empty, clears.

Tables are Parquet folders partitioned by ``dataset`` (and ``is_voted`` for
accounts).  A "replace" overwrites only the partitions present in the new
data (dynamic partition overwrite), so loading one dataset never touches
another.  Jobs are idempotent per partition: a re-run after a lost executor
rewrites the same partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.operators.shape import drop_redundant
from ballotlens.session import remove_path, scratch_path
from ballotlens.sources.readers import path_exists


def _writer(df: DataFrame, partition_by: Sequence[str] | None, sort_within: Sequence[str] | None, bloom: Sequence[str] = ()):
    if sort_within:
        # clustered files: row-group min/max statistics then prune key lookups
        df = df.sortWithinPartitions(*sort_within)
    w = df.write
    for c in bloom:     # of each row group: lookups by value skip the groups without it
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


# ----------------------------------------------------------------------- S6
def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = ("dataset",),
                  sort_within: Sequence[str] | None = None, bloom: Sequence[str] = ()) -> None:
    """Overwrite the partitions present in ``df`` (dynamic), or the whole table
    when it is not partitioned.  ``df`` must not read from ``path``.  ``bloom``
    names columns for point lookups that the files aren't sorted by."""
    # per-write option: no session-wide side effect
    _writer(df, partition_by, sort_within, bloom).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


# ----------------------------------------------------------------------- S7
def append_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = ("dataset",),
                 sort_within: Sequence[str] | None = None, bloom: Sequence[str] = ()) -> None:
    _writer(df, partition_by, sort_within, bloom).mode("append").parquet(path)


# ----------------------------------------------------------------------- S9
def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV export.  ``single_file`` is for small example files only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# ---------------------------------------------------------------------- S15
def load_if_empty(df: DataFrame, path: str, replace: bool = False, **kw) -> str:
    """Skip the load when the target already holds rows, unless ``replace``."""
    spark = df.sparkSession
    if path_exists(spark, path) and not replace:
        has_rows = len(spark.read.parquet(path).limit(1).take(1)) > 0
        if has_rows:
            return "skipped"
    replace_table(df, path, **kw)
    return "loaded"


# ----------------------------------------------------------------------- D4
def clear_dataset(spark: SparkSession, path: str, dataset: str, confirm: bool = False,
                  partition_by: Sequence[str] = ("dataset",)) -> None:
    """Empty one dataset's partition of a table (explicit ``confirm`` needed);
    a dataset that the table doesn't hold is an error.  Partition folders
    escape special characters, so names are compared unescaped."""
    if not confirm:
        raise ValueError("clear_dataset needs confirm=True")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [st.getPath() for st in fs.listStatus(root) if unquote(st.getPath().getName()) == f"{partition_by[0]}={dataset}"]
    if not found:
        raise ValueError(f"no {partition_by[0]} {dataset!r} in {path}")
    for p in found:
        fs.delete(p, True)


# ----------------------------------------------------------------------- D5
def delete_where(spark: SparkSession, path: str, new_path: str, col: str, pattern: str) -> DataFrame:
    """DELETE ... WHERE col LIKE pattern as a new table version: the kept rows
    are written to ``new_path`` (a Spark job cannot overwrite its own input);
    the caller switches readers to the new version.  Returns the new table."""
    from ballotlens.operators.outreach import delete_where_like
    delete_where_like(spark.read.parquet(path), col, pattern).write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


# ----------------------------------------------------------------------- S8
def copy_table(source: DataFrame, target_path: str, copy_rows_fn, dataset: str | None = None,
               partition_col: str = "dataset", **kw) -> DataFrame:
    """Append the not-yet-present rows of ``source`` to the table at
    ``target_path`` (to its part ``dataset``, if the table is partitioned; a
    table that isn't there yet is begun).  Returns one row: source_rows,
    copied, skipped."""
    spark = source.sparkSession
    if path_exists(spark, target_path):
        target = spark.read.parquet(target_path)
        if dataset is not None:
            target = target.filter(F.col(partition_col) == dataset).drop(partition_col)
    else:
        target = source.limit(0)
    new = copy_rows_fn(source, target, **kw)["new"]
    if dataset is not None:
        new = new.withColumn(partition_col, F.lit(dataset))
    # stage the new rows first: the plan reads the target it appends to
    staged = scratch_path(spark, f"copy-{uuid.uuid4().hex[:12]}")
    new.write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    n_new, n_src = rows.count(), source.count()
    append_table(rows, target_path, partition_by=(partition_col,) if dataset is not None else None)
    remove_path(spark, staged)
    return spark.createDataFrame([(n_src, n_new, n_src - n_new)], "source_rows bigint, copied bigint, skipped bigint")


# ----------------------------------------------------------------------- H8
def slim_accounts(spark: SparkSession, path: str, day: str) -> dict[str, str | int]:
    """Move an account table to the slim layout: write it without the old
    columns, check the row count, keep the old folder as
    ``<path>_backup_<day>``, and put the new one in its place.  On a count that
    differs nothing is swapped."""
    old = spark.read.parquet(path)
    new_path, backup = f"{path.rstrip('/')}_slim_{day}", f"{path.rstrip('/')}_backup_{day}"
    parts = [c for c in ("dataset", "is_voted") if c in old.columns]
    _writer(drop_redundant(old), parts, None).mode("overwrite").parquet(new_path)
    n_old, n_new = old.count(), spark.read.parquet(new_path).count()
    if n_old != n_new:
        raise RuntimeError(f"slim copy has {n_new} rows, the table {n_old}")
    jvm = spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, backup, new_path)]
    fs = at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at[1]):
        raise RuntimeError(f"{backup} exists")
    fs.rename(at[0], at[1])
    fs.rename(at[2], at[0])
    return {"rows": n_new, "backup": backup}
