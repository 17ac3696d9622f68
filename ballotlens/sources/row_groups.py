"""Row groups of Parquet files as a table (S4), and loads by row group.

Spark lists the files; each task opens footers of its own files, or reads the
row groups dealt to it, through Arrow: Spark's Parquet reader can neither list
row groups nor read chosen ones.  Row groups are dealt by stretches of a file,
and a task opens each of its files once: a footer names all row groups of its
file, so opening it for every row group would cost their number squared.

``load_row_groups`` loads what a ledger doesn't name yet, in batches of about
``batch_bytes``.  A batch is written to a folder of its own and then committed
by one ledger file.  A load stopped anywhere, also inside a file, goes on with
the row groups that aren't committed; a batch that was written but not
committed is overwritten by the next run, and ``loaded`` reads committed
batches only.  So no row comes twice and none is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.session import remove_path, scratch_path
from ballotlens.sources.readers import path_exists

GROUP = "file_path string, file_bytes long, row_group int, first_row long, rows long, bytes long, columns int"
TASK_BYTES = 128 * 1024 * 1024     # row groups that one task reads
BATCH_BYTES = 256 * 1024**3        # row groups between two commits
STREAM_ROWS = 8_192                # rows of an Arrow batch
STRETCHES = 4                      # stretches of files that a task gets on average


def _open(path: str):
    """The Parquet file at a path as Spark writes it (file:/x, s3a://b/x)."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq
    from urllib.parse import quote
    if path.startswith("file:"):
        return pq.ParquetFile("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/"))
    return pq.ParquetFile(system.open_input_file(inner))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row group of the Parquet files under ``path``: its
    file, number, first row within the file, rows, uncompressed bytes, and the
    file's top-level columns.  Only footers are read; a file without row groups
    gives no row."""
    # the content column isn't selected, so no file is read by the listing
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(path).select("path", "length"))

    def footers(batches):
        import pyarrow as pa
        for b in batches:
            out = [[] for _ in range(7)]
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(p) as f:
                    meta, first = f.metadata, 0
                    for g in range(meta.num_row_groups):
                        one = meta.row_group(g)
                        for col, v in zip(out, (p, size, g, first, one.num_rows, one.total_byte_size, len(f.schema_arrow)), strict=True):
                            col.append(v)
                        first += one.num_rows
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            names = [c.split()[0] for c in GROUP.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return files.mapInArrow(footers, GROUP)


def deal(groups: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file_path, row_group) in partitions of about ``task_bytes``: stretches
    of neighbours in a file stay together, in the file's order."""
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    before = F.sum("bytes").over(Window.partitionBy("file_path").orderBy("row_group")) - F.col("bytes")
    stretch = F.floor(before / max(1, task_bytes // STRETCHES)).alias("stretch")
    return groups.select("file_path", "row_group", stretch).repartition(max(1, -(-size // task_bytes)), "file_path", "stretch") \
        .sortWithinPartitions("file_path", "row_group").select("file_path", "row_group")


def stream_groups(batches, target, open_file=_open):
    """Record batches of schema ``target`` with the rows of the row groups that
    ``batches`` name; neighbours of one file are read from one open file."""
    import pyarrow as pa
    path = f = None
    try:
        for b in batches:
            for at, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != path:
                    if f is not None:
                        f.close()
                    path, f = at, open_file(at)
                    there = set(f.schema_arrow.names)
                    wanted = [n for n in target.names if n in there]
                if not wanted:      # its rows still count
                    yield pa.RecordBatch.from_arrays([pa.nulls(f.metadata.row_group(group).num_rows, t.type) for t in target], schema=target)
                    continue
                for part in f.iter_batches(STREAM_ROWS, row_groups=[group], columns=wanted):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(t.name).cast(t.type) if t.name in there else pa.nulls(part.num_rows, t.type) for t in target], schema=target)
    finally:
        if f is not None:
            f.close()


def read_groups(groups: DataFrame, schema: T.StructType, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of the given row groups, with ``schema``'s columns only; a
    column that a file doesn't have is NULL.  A row group is streamed by one
    task, however large it is."""
    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        yield from stream_groups(batches, to_arrow_schema(schema))

    return deal(groups, task_bytes).mapInArrow(rows, schema)


def ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Committed row groups and their ``load_batch``."""
    schema = T.StructType.fromDDL(GROUP + ", load_batch long")
    if not path_exists(spark, ledger_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger_path)


def loaded(spark: SparkSession, target_path: str, ledger_path: str) -> DataFrame:
    """Rows of committed batches; a batch that isn't committed is not read."""
    done = ledger(spark, ledger_path).select("load_batch").distinct()
    return spark.read.parquet(target_path).join(done, "load_batch", "left_semi")


def load_row_groups(spark: SparkSession, source: str, target_path: str, ledger_path: str, schema: T.StructType | None = None,
                    transform: Callable[[DataFrame], DataFrame] | None = None, batch_bytes: int = BATCH_BYTES, task_bytes: int = TASK_BYTES,
                    before_commit: Callable[[int], None] | None = None) -> int:
    """Load every row group of ``source`` that isn't committed; returns the
    batches it committed.  A committed file that has another size now is an
    error: its row groups aren't those that were loaded.  ``before_commit`` runs
    when a batch is written but not committed."""
    schema = schema or spark.read.option("recursiveFileLookup", "true").parquet(source).schema
    done = ledger(spark, ledger_path)
    # what this run loads is settled before it begins: files that come later wait for the next run
    planned = scratch_path(spark, f"row-groups-{uuid.uuid4().hex[:12]}")
    known = done.groupBy("file_path", "row_group").agg(F.max("file_bytes").alias("was"), F.max("load_batch").alias("in_batch"))
    row_groups(spark, source).join(known, ["file_path", "row_group"], "left").write.parquet(planned)
    plan = spark.read.parquet(planned)
    try:
        changed = plan.filter("was <> file_bytes").select("file_path").first()
        if changed is not None:
            raise ValueError(f"{changed[0]} has changed since it was loaded")
        todo = plan.filter("in_batch is null").drop("was", "in_batch")
        size = todo.agg(F.sum("bytes")).first()[0]
        if size is None:
            return 0
        batches = max(1, -(-size // batch_bytes))
        first = (done.agg(F.max("load_batch")).first()[0] or 0) + 1
        for k in range(batches):
            part = todo.filter(F.pmod(F.xxhash64("file_path", "row_group"), F.lit(batches)) == k)
            rows = read_groups(part, schema, task_bytes)
            # whole folders are overwritten: what a stopped run left there goes, even if this batch is empty
            (transform(rows) if transform else rows).write.mode("overwrite").parquet(f"{target_path}/load_batch={first + k}")
            if before_commit is not None:
                before_commit(first + k)
            # one file, so the commit is there as a whole or not at all; a row for each row group of the batch
            part.coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/load_batch={first + k}")
        return batches
    finally:
        remove_path(spark, planned)
