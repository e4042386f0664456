"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.scratch import scratch_dir

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it the shuffle files of a query go as soon as the query ends, not
    when the driver's garbage is next collected.  Meant for writes: nothing reads
    their shuffles again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir``
    and read it back: the lineage ends there, a lost executor costs a re-read,
    the planner knows the table's true size, and the shuffles behind it go.
    ``options``: the writer's."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables from ``stash`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df.stash_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus`` (null key: null)."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % F.lit(modulus)


def trim() -> None:
    """Give freed memory back to the system.  A worker lives on, and what its
    arrays took would stay with it beside its next tasks and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def trimmed(function):
    """``function`` of an iterator, with a ``trim`` once it has let go of all it held."""
    def run(batches):
        yield from function(batches)
        trim()

    return run


#: Rows of an Arrow batch, at most: texts can be long, and the JVM and a Python
#: worker each hold a batch.
BATCH_ROWS = 1_000


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (the
    session's setting where that is smaller; it stays set for the session)."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(setting))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(trimmed(function), schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each
    piece (one row at least): memory stays bounded however long the texts are."""
    for batch in batches:
        rows, size = batch.num_rows, max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(rows * limit / size))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()  # the worker lives on; its next task may be another operator's


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``name`` as its last column; a column of that name gives way."""
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values],
                                      names=[batch.schema.names[i] for i in keep] + [name])
