"""Group INSERT statements of a SQL dump into batches, and write the dump anew.

A line ``INSERT INTO `t` VALUES ...;``, blanks around it aside, belongs to a run of consecutive
INSERT lines into the same table; a run ends at another table or at any
other line; each run is cut every ``batch_size`` lines.

The windows over blocks run per file (one row per block of lines; without a
file column, one group for all).  Distributed gaps-and-islands: a window over a whole file would put the file
in one task, so windows are partitioned by (file, line block).  Per-block
summaries (one row per block, so their size is lines / block_lines) carry
the dense line number, the previous line's table and the open run across
block boundaries.

``rewrite_dump`` turns each batch into one multi-row INSERT: a line's new text
follows from its place in the batch, so lines stay rows and nothing is glued.
``write_dump`` writes them in file order, range-partitioned by (file, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.functions.text import PY_WS

INSERT_RE = r"(?s)^INSERT INTO `([^`]+)` VALUES (.+);$"


def _lines_in_runs(lines: DataFrame, line_col: str, line_no_col: str, file_col: str | None, block_lines: int) -> DataFrame:
    """(_f, line_no, line, tbl, next_tbl, _idx, run_idx, run_line): every line, its
    table if it is an INSERT, the next line's, and where its run starts."""
    f = F.col(file_col) if file_col else F.lit("")
    txt = F.btrim(F.col(line_col), F.lit(PY_WS))
    tbl = F.when(txt.rlike(INSERT_RE), F.regexp_extract(txt, INSERT_RE, 1))
    df = lines.select(f.alias("_f"), F.col(line_no_col).alias("line_no"), F.col(line_col).alias("line"), tbl.alias("tbl")) \
        .withColumn("_b", F.floor(F.col("line_no") / F.lit(block_lines)))

    w = Window.partitionBy("_f", "_b").orderBy("line_no")
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_prev_in", F.lag("tbl").over(w)).withColumn("_next_in", F.lead("tbl").over(w))
    # a start that does not depend on the previous block: not the block's first line
    inner_start = (F.col("_rn") > 1) & F.col("tbl").isNotNull() & \
        (F.col("_prev_in").isNull() | (F.col("_prev_in") != F.col("tbl")))

    # one summary row per block (size = lines / block_lines): everything needed
    # to carry numbering, the previous table and the open run across blocks
    blocks = df.groupBy("_f", "_b").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("line_no").alias("_first_line"),
        F.min_by("tbl", "line_no").alias("_first_t"), F.max_by("tbl", "line_no").alias("_last_t"),
        F.max(F.when(inner_start, F.col("_rn"))).alias("_in_rn"),
        F.max(F.when(inner_start, F.col("line_no"))).alias("_in_line"))
    wb = Window.partitionBy("_f").orderBy("_b")
    blocks = blocks.select(
        "*", F.coalesce(F.sum("_cnt").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag("_last_t").over(wb).alias("_prev_blk_t"), F.lead("_first_t").over(wb).alias("_next_blk_t"))
    first_starts = F.col("_first_t").isNotNull() & \
        (F.col("_prev_blk_t").isNull() | (F.col("_prev_blk_t") != F.col("_first_t")))
    blocks = blocks.withColumn("_bs_idx", F.coalesce(F.col("_off") + F.col("_in_rn"),
                                                     F.when(first_starts, F.col("_off") + 1))) \
        .withColumn("_bs_line", F.coalesce(F.col("_in_line"), F.when(first_starts, F.col("_first_line"))))
    prior = wb.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", "_off", "_cnt", "_prev_blk_t", "_next_blk_t",
                           F.max("_bs_idx").over(prior).alias("_c_idx"), F.max("_bs_line").over(prior).alias("_c_line"))

    df = df.join(blocks, ["_f", "_b"], "left")
    prev_t = F.when(F.col("_rn") == 1, F.col("_prev_blk_t")).otherwise(F.col("_prev_in"))
    df = df.withColumn("_idx", F.col("_off") + F.col("_rn"))
    start = F.col("tbl").isNotNull() & (prev_t.isNull() | (prev_t != F.col("tbl")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_rs_idx", F.max(F.when(start, F.col("_idx"))).over(upto)) \
        .withColumn("_rs_line", F.max(F.when(start, F.col("line_no"))).over(upto))
    next_t = F.when(F.col("_rn") == F.col("_cnt"), F.col("_next_blk_t")).otherwise(F.col("_next_in"))
    return df.select("_f", "line_no", "line", "tbl", next_t.alias("next_tbl"), "_idx",
                     F.coalesce(F.col("_rs_idx"), F.col("_c_idx")).alias("run_idx"), F.coalesce(F.col("_rs_line"), F.col("_c_line")).alias("run_line"))


def insert_statement_batches(lines: DataFrame, batch_size: int = 1000, line_col: str = "line",
                             line_no_col: str = "line_no", file_col: str | None = None,
                             block_lines: int = 1_000_000) -> DataFrame:
    """One row per batch: table, run start line, batch number within the run,
    first / last line and the number of statements."""
    df = _lines_in_runs(lines, line_col, line_no_col, file_col, block_lines)
    ins = df.filter(F.col("tbl").isNotNull()).select(
        "_f", "tbl", "line_no", F.col("run_line").alias("run_start"),
        F.floor((F.col("_idx") - F.col("run_idx")) / F.lit(batch_size)).cast("bigint").alias("batch_no"))
    out = ins.groupBy("_f", "run_start", "batch_no").agg(
        F.first("tbl").alias("table_name"), F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"), F.count(F.lit(1)).cast("bigint").alias("n_lines"))
    cols = ["table_name", "run_start", "batch_no", "first_line", "last_line", "n_lines"]
    return out.select(*(["_f"] if file_col else []), *cols).withColumnRenamed("_f", file_col or "_f")


def rewrite_dump(lines: DataFrame, batch_size: int = 1000, line_col: str = "line", line_no_col: str = "line_no",
                 file_col: str | None = None, block_lines: int = 1_000_000) -> DataFrame:
    """(file column, line number, text): the dump with one INSERT a batch.  A
    batch's first line gets the statement's head before it, its lines end with
    commas and the last with a semicolon; other lines stay as they are."""
    df = _lines_in_runs(lines, line_col, line_no_col, file_col, block_lines)
    place = (F.col("_idx") - F.col("run_idx")) % batch_size
    last = (place == batch_size - 1) | F.col("next_tbl").isNull() | (F.col("next_tbl") != F.col("tbl"))
    head = F.when(place == 0, F.concat(F.lit("INSERT INTO `"), F.col("tbl"), F.lit("` VALUES\n"))).otherwise("")
    values = F.regexp_extract(F.btrim("line", F.lit(PY_WS)), INSERT_RE, 2)
    text = F.when(F.col("tbl").isNull(), F.col("line")).otherwise(F.concat(head, values, F.when(last, ";").otherwise(",")))
    return df.select(*([F.col("_f").alias(file_col)] if file_col else []), F.col("line_no").alias(line_no_col), text.alias("text"))


def write_dump(rewritten: DataFrame, path: str, file_col: str | None = None, line_no_col: str = "line_no") -> None:
    """Text files under ``path`` (a folder for each file), whose names sort in
    the order of the lines."""
    by = [*([file_col] if file_col else []), line_no_col]
    ordered = rewritten.repartitionByRange(*by).sortWithinPartitions(*by).select(*([file_col] if file_col else []), "text")
    w = ordered.write.mode("overwrite")
    (w.partitionBy(file_col) if file_col else w).text(path)


def number_lines(spark, path: str) -> DataFrame:
    """Text files as (file, line_no, line), lines numbered from 1 in each file.

    Within an input split rows keep their order, so their running ids count the
    split's lines; a summary of one row a split carries the offset of the lines
    in the file's earlier splits.  No line leaves the JVM, and no window runs
    over lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return lines.join(splits, ["file", "_at"]).select(
        "file", (F.col("_off") + F.col("_row") - F.col("_first") + 1).alias("line_no"), "line")
