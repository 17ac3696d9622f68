"""Readers: CSV bound by header name, Parquet, multi-dataset routing, inventory.

CSV files are read **without** a schema, so every column is a string named by
the file's own header; binding is by name (``unionByName``), never by
position.  Spark's CSV reader binds columns by position when a folder's files
order their columns differently, so each path passed here must hold files of
one layout (one file, or one folder of same-header part files).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.operators.shape import alias_columns
from ballotlens.sources.quoted_csv import read_quoted_csv


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster's file system (driver metadata call)."""
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # noqa: BLE001 - no JVM handle (Spark Connect): ask the reader
        try:
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            return True
        except Exception:  # noqa: BLE001
            return False
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


# ------------------------------------------------------------------ S1 / S2
def read_csv_by_name(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False,
                     skip_missing: bool = False, quoted_newlines: bool = False) -> DataFrame:
    """Header CSV, quoted fields, UTF-8, all columns strings named by the header.

    Files are split over tasks.  Where quoted fields may hold newlines,
    ``quoted_newlines`` glues their lines, still in splits (one shuffle of the
    text); ``multi_line`` is Spark's own way, a whole file in one task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for p in paths:
        if skip_missing and not path_exists(spark, p):
            continue
        if quoted_newlines and not multi_line:
            frames.append(read_quoted_csv(spark, p))
            continue
        frames.append(spark.read.option("header", True).option("multiLine", multi_line)
                      .option("escape", '"').option("encoding", "UTF-8").csv(p))
    if not frames:
        raise FileNotFoundError(f"none of {paths} exists")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_proposals_csv(spark: SparkSession, paths: str | Sequence[str], quoted_newlines: bool = True, **kw) -> DataFrame:
    """Proposal CSV: proposal texts hold newlines, so records are glued."""
    return read_csv_by_name(spark, paths, quoted_newlines=quoted_newlines, **kw)


def read_accounts_csv(spark: SparkSession, paths: str | Sequence[str],
                      aliases: Mapping[str, Sequence[str]] | None = None, **kw) -> DataFrame:
    """Account / outreach CSV; ``aliases`` maps alternative column names.  Their
    fields hold no newlines: lines are records, without a shuffle, unless
    ``quoted_newlines`` is set."""
    df = read_csv_by_name(spark, paths, **kw)
    return alias_columns(df, aliases) if aliases else df


# ----------------------------------------------------------------------- S3
def read_accounts_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                          aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Parquet accounts: one task per split (row groups), pruned columns,
    filters pushed into the scan by whatever is applied later."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    if aliases:
        df = alias_columns(df, aliases)
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    return df


# ----------------------------------------------------------------------- S4
def parquet_inventory(df: DataFrame) -> DataFrame:
    """Rows per file (from the hidden file metadata) plus the column count."""
    ncols = len(df.columns)
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.max(F.col("_metadata.file_size")).cast("bigint").alias("file_size"),
    ).withColumn("columns", F.lit(ncols))


# ----------------------------------------------------------------------- S5
def load_datasets(spark: SparkSession, routes: Mapping[str, str], reader=None,
                  dataset_col: str = "dataset") -> DataFrame:
    """Read each path, tag its rows with the dataset name, union by name.  A
    missing path is skipped; the rest still load (one job, not one per file)."""
    reader = reader or (lambda s, p: s.read.parquet(p))
    frames = []
    for path, name in routes.items():
        if not path_exists(spark, path):
            continue
        frames.append(reader(spark, path).withColumn(dataset_col, F.lit(name)))
    if not frames:
        raise FileNotFoundError("no input path exists")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------- S11
def sample_rows(df: DataFrame, n: int = 3, order: Sequence[str] = ("id",)) -> DataFrame:
    """The first ``n`` rows in a fixed order (repeatable, unlike LIMIT alone)."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)
