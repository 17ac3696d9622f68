"""Session helpers: one place for the Spark settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale. Shuffle partition count is a starting point:
# AQE coalesces small partitions and splits skewed ones at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture for error messages costs a stack walk per
    # Column built on the driver; plans with many expressions build 2x faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = "local[8]", shuffle_partitions: int | None = None,
                app: str = "ballotlens") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, call with ``master=None`` and let spark-submit decide; the
    partition count should then be sized so one shuffle partition is ~128-256 MB.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is also every executor (default heap 1g)
            b = b.config("spark.driver.memory", "8g")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = 8          # local tests: about the core count
    if shuffle_partitions is not None:  # on a cluster: keep the site setting, or use size_shuffles()
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (survives lost executors).  Only a
    local session (tests) may fall back to a fresh folder of its own; on a
    cluster an unset setting is an error, never a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns checkpointing
        sc = None
    if not d:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (e.g. on HDFS / S3)")
        d = tempfile.mkdtemp(prefix="ballotlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: later consumers start from the files (lineage cut), and
    the files outlive any executor.  Use for an intermediate read by several
    reports; the folder name is unique per call."""
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours through the cluster's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 * 1024 * 1024,
                  floor: int = 200) -> int:
    """Size the initial shuffle partition count for an input of ``input_bytes``
    so each partition holds about ``target_bytes`` (fits executor memory
    without spilling); AQE then coalesces small ones and splits skewed ones
    toward the same advisory size.  Returns the partition count it set."""
    n = max(floor, -(-input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return n
