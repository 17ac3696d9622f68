"""INSERT IGNORE as a stream (D1, D2 with R1).

New outreach files go into the table micro-batch by micro-batch; each batch
writes a partition of its own, holding the rows that an INSERT IGNORE would add
to the batches before it.  A batch that ran between its write and its commit is
repeated by Spark under the same number: it leaves out its own partition when it
looks for duplicates and overwrites it with the same rows, so nothing comes
twice.  A ledger tells each batch's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.operators import outreach as ot
from ballotlens.sources import sinks
from ballotlens.sources.readers import path_exists

FIRST = -1          # the batch of rows that were there before the stream


def begin_table(rows: DataFrame, table_path: str) -> None:
    """Start the table with given rows."""
    sinks.replace_table(rows.withColumn("batch", F.lit(FIRST).cast("long")), table_path, partition_by=("batch",))


def read_table(spark: SparkSession, table_path: str, rows: T.StructType) -> DataFrame:
    """The table's rows with their ``batch``; empty if it isn't there."""
    schema = T.StructType([f for f in rows.fields if f.name != "batch"] + [T.StructField("batch", T.LongType())])
    if not path_exists(spark, table_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(table_path)


def stream_insert_ignore(spark: SparkSession, source_dir: str, table_path: str, ledger_path: str, checkpoint_dir: str,
                         prepare: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] = ("id",), fmt: str = "parquet",
                         schema: T.StructType | None = None, max_files_per_trigger: int = 64,
                         before_commit: Callable[[int], None] | None = None) -> None:
    """Load every file of ``source_dir`` not loaded yet, oldest first; of rows of
    one key triple the first by ``order`` in the earliest batch stays.
    ``before_commit`` runs when a batch is written but not committed."""
    schema = schema or spark.read.format(fmt).load(source_dir).schema

    def load(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        earlier = read_table(spark, table_path, rows.schema).filter(F.col("batch") < number).drop("batch")
        new = ot.insert_ignore(earlier, rows, order).withColumn("batch", F.lit(number).cast("long"))
        sinks.replace_table(new, table_path, partition_by=("batch",))
        added = read_table(spark, table_path, rows.schema).filter(F.col("batch") == number).agg(F.count("*").alias("added"))
        report = rows.agg(F.count("*").alias("source_rows")).select("source_rows", added.scalar().alias("added")) \
            .select(F.lit(number).cast("long").alias("batch"), "source_rows", "added", (F.col("source_rows") - F.col("added")).alias("skipped"))
        sinks.replace_table(report.coalesce(1), ledger_path, partition_by=("batch",))
        if before_commit is not None:
            before_commit(number)

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir)
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
