"""Session helpers.

The library never creates a session on its own inside an operator; callers
pass theirs.  ``get_spark`` is for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "docweave",
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session for scripts, tests and the bench: AQE with skew-join
    splitting, Arrow, UI off, speculation off.  The default master is
    ``local[$BENCH_CPUS]`` with one shuffle partition per core; on a cluster
    pass the master and size ``shuffle_partitions`` to the data (AQE then
    coalesces small ones)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DOCWEAVE_DRIVER_MEMORY", "16g"))
        # provider calls are side effects: never run a task twice on purpose
        .config("spark.speculation", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # PySpark records the Python call site of every API call for error
        # messages (a stack walk + JVM round trips each); plans are built
        # from hundreds of Column calls, so skip it outside debugging
        .config("spark.python.sql.dataFrameDebugging.enabled",
                os.environ.get("DOCWEAVE_DF_DEBUG", "false"))
    )
    if shuffle_partitions or master.startswith("local"):  # a cluster keeps its own setting
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if master.startswith("local"):  # on a cluster the folder comes from spark.checkpoint.dir
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` is set by the operator and is used
    as is (unset on a cluster is an error).  Only in local mode, when it is
    unset (tests), do we pick a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not str(sc.master).startswith("local"):
        # a machine-local folder is wrong on a cluster: every executor would
        # write to its own disk and nothing could be read back after a loss
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every "
                           "executor can reach (shared file system or object store)")
    path = tempfile.mkdtemp(prefix="docweave-ckpt-")  # local mode only (tests, laptops)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


#: Rows of an Arrow batch, at most: the JVM and a Python worker each hold a batch
#: of whole texts, several times over while it is worked on.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows for Python stages (the session's
    setting where that is smaller; it stays set for the session)."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


# key of each supplied table: used to spread under-partitioned scans
TABLE_KEYS = {
    "documents": ["doc_id"], "pages": ["page_id"], "events": ["event_id"],
    "conversations": ["conv_id"], "orders": ["o_orderkey"], "labels": ["doc_id"],
    "benchmark": ["item_id"],
}


def partition_counts(df):
    """(cluster slots, partitions of df's plan); partitions is None where the
    session cannot tell (Spark Connect) - callers then leave df as is."""
    try:
        return df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001
        return None, None


def spread(df, key_cols=(), min_partitions: int | None = None):
    """Hash-spread ``df`` over the cluster's slots, but only when the scan
    gave fewer partitions than slots (one small file = one task).  Inputs
    already split into many partitions pass through: no extra shuffle.
    Spreading by the key a later ``groupBy`` uses lets that aggregation reuse
    the partitioning instead of shuffling again.  ``min_partitions`` raises the
    bar for inputs whose few partitions are very unequal (a union of small
    single-file scans).
    """
    if os.environ.get("DOCWEAVE_SPREAD", "1") == "0":  # plan inspection: as a large input
        return df
    slots, parts = partition_counts(df)
    if parts is None or parts >= (min_partitions or slots):
        return df
    return df.repartition(slots, *key_cols) if key_cols else df.repartition(slots)


def table(spark: SparkSession, sf_dir: str, name: str, spread_by=None):
    """Read one supplied Parquet table, spread over the slots if the file is
    a single split (``spread_by``: key columns; default the table key; ``()``
    reads the scan as is)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = TABLE_KEYS.get(name) if spread_by is None else list(spread_by)
    if not keys:
        return df  # dimension tables, or the caller asked for the scan as is
    return spread(df, keys)
