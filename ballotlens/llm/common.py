"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import sys
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.session import ensure_checkpoint_dir

#: rows handed to a Python worker at once: texts may be 100 KB each, so a
#: batch stays at tens of MB
ROWS_PER_BATCH = 512


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the application's Python workers this package, once: they can't
    import it from the driver's folders unless it was installed or submitted
    with ``--py-files``.  Spark serves the file to executors as they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    target = f"{shared_path(spark, 'code')}/ballotlens_code.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts fit a worker (and
    see to it that workers have this package)."""
    ship_package(spark)
    if int(spark.conf.get(_BATCH, "10000")) not in range(1, ROWS_PER_BATCH + 1):
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """So many rows to an Arrow batch in the jobs that run inside."""
    ship_package(spark)
    before = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the folder of ``spark.checkpoint.dir`` and read
    back: later steps start from files that all executors share, so a lost
    executor costs no recomputation of earlier steps."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _passing.get():
        _passing.get()[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a ``stored`` table after its last use."""
    drop_stored(df.sparkSession, df._stored_at)


#: tables to remove, a list for each ``temporary`` that is open
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that are ``stored`` inside are removed at the end: what is to
    outlive them has to be written before, with ``lasting``."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for p in paths:
            drop_stored(spark, p)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``stored``, but outlives the innermost ``temporary``."""
    token = _passing.set(_passing.get()[:-1])
    try:
        return stored(df, name)
    finally:
        _passing.reset(token)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_path`` named, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_memory() -> None:
    """What freed batches and texts leave in the allocators goes back to the
    system: a worker's process is shared by operators that come one by one."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def forget_vocabularies() -> None:
    """A Python worker outlives its tasks and serves one operator after the
    other: drop the vocabularies, and what they remember, of earlier ones."""
    for name in ("bpe", "token_counts"):
        module = sys.modules.get(f"ballotlens.llm.{name}")
        if module is not None and module.load.cache_info().currsize:
            module.load.cache_clear()
    release_memory()


def slices(texts: list[str], most: int = 1 << 19):
    """(start, end) of runs of texts of about ``most`` characters at most, or of
    one longer text: what array work on a batch takes stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text column as a string; null counts as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text): extra columns, whatever their names, go no further."""
    return df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))


def arrays_to_batch(schema, columns):
    """A record batch of the named columns (lists or arrays) with the Arrow
    types of ``schema`` (a pyarrow schema)."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)
