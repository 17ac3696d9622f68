"""All pages of a listing at once (O1-O3).

Rows are range-partitioned and sorted in the listing's order and written once.
A row's place is its place in its partition plus the rows of the partitions
before it, which a summary of one row a partition tells: no window runs over
the rows.  The page index holds each page's boundary keys, so any page, however
deep, is a range filter that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.session import materialize

_IN_PARTITION = (1 << 33) - 1        # the row's part of monotonically_increasing_id


def with_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``position``, from 0 in ``order`` (a unique one, so that places
    are settled); a written table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    written = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", at.bitwiseAND(F.lit(_IN_PARTITION))), "ordered")
    parts = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # a row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return written.join(parts, "_part").withColumn("position", F.col("_before") + F.col("_row")).select(*df.columns, "position")


def with_pages(df: DataFrame, limit: int = 50, order: Sequence[Column] | None = None) -> DataFrame:
    """``df`` with each row's page and place on it, both from 1 (default order: id DESC)."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    rows = with_positions(df, list(order) if order is not None else [F.col("id").desc()])
    return rows.select(*df.columns, (F.floor(F.col("position") / limit) + 1).alias("page"), (F.col("position") % limit + 1).alias("place"))


def page_index(paged: DataFrame, key: str = "id") -> DataFrame:
    """(page, low, high, rows): the range of ``key`` on each page."""
    return paged.groupBy("page").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))


def indexed_page(df: DataFrame, index: DataFrame, page_no: int, key: str = "id", descending: bool = True) -> DataFrame:
    """One page by its boundary keys (a row of the index): a filter that Parquet's
    statistics serve.  A page beyond the last is empty."""
    bounds = index.filter(F.col("page") == page_no).first()
    if bounds is None:
        return df.limit(0)
    return df.filter(F.col(key).between(bounds["low"], bounds["high"])).orderBy(F.col(key).desc() if descending else F.col(key).asc())
