"""Incremental summaries of a folder that keeps receiving files.

The reference handles one file per run; on Spark the same column rules run
on a stream of listed files: each trigger picks up only new files, routes them (stream-static broadcast join to the 17-row format table),
extracts text, summarises it and appends to a Parquet sink.  Progress lives
in the checkpoint folder, so a restarted or failed job resumes where it
stopped and never re-reads a file it has committed.

No aggregation is involved, so no watermark is needed: the query maps a file to
its summary row.  The one state is the set of paths seen, spread over the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import local_summary, shorten_title
from docweave.operators.structured import csv_heads
from docweave.sources.bigtext import BLOCK_BYTES, big_text_summaries
from docweave.sources.files import DEFAULT_MAX_BYTES, load_corpus_text
from docweave.sources.formats import route_by_extension
from docweave.sources.listing import empty_files, listed_files, with_content

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
SUMMARY_COLS = ["path", "name", "title", "ext", "kind", "n_chars", "summary", "error_class", "error"]


def file_stream(spark: SparkSession, source_dir: str, glob: str | None = None,
                max_files_per_trigger: int | None = None,
                max_bytes: int | None = DEFAULT_MAX_BYTES) -> DataFrame:
    """New files as rows.  Every trigger lists the folder on the executors; the
    paths seen are state there, and the driver holds no list of files.  Files of
    no length are rows too.  Files over ``max_bytes`` arrive as ``too_large``
    rows without content, so one huge file neither fails the query nor disappears.
    ``max_files_per_trigger`` needs Spark's own source, which lists on the driver."""
    no_error = {"error_class": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    too_large = F.col("length") > max_bytes if max_bytes else F.lit(False)
    large = {"error_class": F.when(too_large, F.lit("too_large")),
             "error": F.when(too_large, F.concat(F.lit(f"File is larger than {max_bytes} bytes: "), F.col("length").cast("string")))}
    if not max_files_per_trigger:
        return with_content(listed_files(spark, source_dir, glob, stream=True), max_bytes).withColumns(large)

    def source():
        reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                  .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", int(max_files_per_trigger)))
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(source_dir)

    readable = source().where(~too_large).withColumns(no_error)
    files = readable.unionByName(empty_files(spark, source_dir, glob, stream=True).withColumns(no_error))
    if not max_bytes:
        return files
    return files.unionByName(source().where(too_large).withColumn("content", F.lit(None).cast("binary")).withColumns(large))


def summarize_files(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None
                    ) -> DataFrame:
    """Batch or streaming: one summary row per file (T6 over extracted text)."""
    texts = load_corpus_text(files, extractors=extractors)
    return texts.select(
        "path", "name", shorten_title("stem").alias("title"), "ext", "kind",
        F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("error_class").isNull(), local_summary("text")).alias("summary"),
        "error_class", "error")


def summarize_corpus(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``summarize_files`` for a batch with files of any size (``read_corpus``):
    those too large for a cell are read in blocks where they are text, and by
    their head where they are CSV; other formats stay ``too_large``."""
    large = F.col("error_class") == "too_large"
    found = summarize_files(files.where(~F.coalesce(large, F.lit(False))), extractors)
    custom = [e.lower() for e in extractors or ()]
    rest = route_by_extension(files.where(large).drop("content", "error_class", "error"), "path")
    rest = rest.withColumn("how", F.when(F.col("ext").isin(*custom) if custom else F.lit(False), "none").otherwise(F.col("kind")))
    texts = big_text_summaries(rest.where("how = 'text'").select("path", "length"), block_bytes=block_bytes)
    heads = csv_heads(rest.where("how = 'csv'").select("path"))
    heads = heads.select("path", F.char_length("preview").alias("n_chars"), local_summary("preview").alias("summary"),
                         F.when(F.col("error").isNotNull(), F.lit("bad_csv")).alias("_class"), F.col("error").alias("_error"))
    read = texts.withColumns({"_class": F.lit(None).cast("string"), "_error": F.lit(None).cast("string")}).unionByName(heads)
    named = rest.select("path", "name", shorten_title("stem").alias("title"), "ext", "kind", "length", "how").join(read, "path", "left")
    unread = ~F.coalesce(F.col("how").isin("text", "csv"), F.lit(False))
    return found.unionByName(named.select(
        "path", "name", "title", "ext", "kind", "n_chars", "summary",
        F.when(unread, F.lit("too_large")).otherwise(F.col("_class")).alias("error_class"),
        F.when(unread, F.concat(F.lit("File is too large for its format: "), F.col("length").cast("string"), F.lit(" bytes")))
         .otherwise(F.col("_error")).alias("error")))


def run_incremental(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                    glob: str | None = None, extractors=None,
                    max_files_per_trigger: int | None = None, available_now: bool = True,
                    max_bytes: int | None = DEFAULT_MAX_BYTES):
    """Start (and with ``available_now`` wait for) the incremental job."""
    out = summarize_files(file_stream(spark, source_dir, glob, max_files_per_trigger, max_bytes),
                          extractors)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def run_incremental_report(spark: SparkSession, source_dir: str, report_dir: str,
                           checkpoint_dir: str, glob: str | None = None, extractors=None,
                           available_now: bool = True):
    """G1 over a folder that keeps receiving files.

    A streaming aggregation per extension (complete mode; its state is one
    row per extension, so it stays tiny however many files arrive).  Every
    trigger rewrites the report table at ``report_dir`` with the running
    totals and the overall ``all_ok`` flag.
    """
    from docweave.operators.report import extension_totals, with_overall_flag

    texts = load_corpus_text(file_stream(spark, source_dir, glob), extractors=extractors)
    per_ext = extension_totals(texts)

    def publish(batch: DataFrame, batch_id: int) -> None:
        # the batch is the whole report (complete mode): one row per extension
        with_overall_flag(batch).write.mode("overwrite").parquet(report_dir)

    writer = (per_ext.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query
