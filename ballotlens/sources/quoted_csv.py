"""CSV whose quoted fields hold newlines, read in splits.

Spark's ``multiLine`` reads such a file right, but whole in one task.  Here a
file is read as lines in its input splits, and whether a line begins inside a
quoted field follows from the quotes before it:

1. within a split, each line's count of quotes before it (a window over the
   lines of one input split, so a task holds one split);
2. a summary of one row a split - its parity, and how many records begin in it
   if it begins outside or inside a field - and running totals of those over
   the file's splits;
3. lines that are a record by themselves go on as they are; only lines of
   longer records are gathered, by (file, record), and glued in order.

Records are parsed by Spark's own CSV parser.  Doubled quotes inside fields
count twice and change nothing.  Quotes belong to quoted fields (RFC 4180): a
file in which they don't pair up is an error, and so is a record of more than
``MAX_RECORD`` characters, which a stray pair of quotes would make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_RECORD = 64 << 20


def _checked(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def csv_records(spark: SparkSession, path: str, max_record: int = MAX_RECORD) -> DataFrame:
    """(file, record, text): the records of each file, numbered from 1, with the
    newlines of their fields; empty lines between records are left out."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")).withColumn("odd", (quotes % 2).cast("long"))
    in_split = Window.partitionBy("file", "at").orderBy("row")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)

    splits = lines.groupBy("file", "at").agg(F.sum("odd").alias("odd"), F.count_if(F.col("before") == 0).alias("outside"),
                                             F.count_if(F.col("before") == 1).alias("inside"))
    by_file = Window.partitionBy("file").orderBy("at")
    prior = by_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "at", "outside", "inside", (F.coalesce(F.sum("odd").over(prior), F.lit(0)) % 2).alias("state"),
                           (F.sum("odd").over(Window.partitionBy("file")) % 2 == 1).alias("open"))
    begun = F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside"))
    splits = splits.select("file", "at", "state", "open", F.coalesce(F.sum(begun).over(prior), F.lit(0)).alias("records_before"))

    begins = (F.col("before") + F.col("state")) % 2 == 0
    numbered = (lines.join(splits, ["file", "at"]).withColumn("begins", begins)
                .withColumn("record", F.col("records_before") + F.sum(F.col("begins").cast("long")).over(in_split)))
    text = _checked(F.col("open"), "a quoted field of a file is never closed", F.col("line"))
    numbered = numbered.select("file", "record", "at", "row", "begins", "odd", text.alias("line"))

    alone = numbered.filter(F.col("begins") & (F.col("odd") == 0) & (F.col("line") != "")).select("file", "record", F.col("line").alias("text"))
    parts = numbered.filter(~F.col("begins") | (F.col("odd") == 1))
    sizes = parts.groupBy("file", "record").agg(F.sum(F.length("line") + 1).alias("size"))
    parts = parts.join(sizes, ["file", "record"]).withColumn("line", _checked(F.col("size") > max_record, f"a record of more than {max_record} characters", F.col("line")))
    glued = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "row", "line"))).alias("parts"))
    return alone.unionByName(glued.select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text")))


def read_quoted_csv(spark: SparkSession, path: str, max_record: int = MAX_RECORD) -> DataFrame:
    """The rows of header CSV files, every column a string named by the header
    (the files of one path have one header, on one line)."""
    options = {"escape": '"', "encoding": "UTF-8"}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    rows = csv_records(spark, path, max_record).filter("record > 1")
    return rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
