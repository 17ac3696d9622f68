"""Resumable bulk load on Structured Streaming.

The file source remembers (in the checkpoint) which input files were
committed; the file sink writes each micro-batch exactly once.  Re-running
after an interruption, or after new files arrive, loads only the files not
yet committed: no duplicates, no skipped files, and no row-count arithmetic
over row groups.  ``trigger(availableNow=True)`` processes what is there and
stops, so it runs as a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def resumable_load(spark: SparkSession, source_dir: str, target_dir: str, checkpoint_dir: str,
                   transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
                   max_files_per_trigger: int | None = 64, schema=None, partition_by: list[str] | None = None) -> None:
    """Load every not-yet-loaded file of ``source_dir`` into ``target_dir``."""
    if schema is None:
        schema = spark.read.format(fmt).load(source_dir).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    if transform is not None:
        stream = transform(stream)
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir) \
        .option("path", target_dir).outputMode("append").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
