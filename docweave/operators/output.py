"""Output normalisation and sinks (O1-O3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.jsontext import json_pretty, strip_fence
from docweave.functions.text import strip_ws
from docweave.sources.formats import SUFFIX_PATTERN
from docweave.sources.scratch import scratch_dir


# ---- fixed values ----------------------------------------------------------
MSG_TARGET_MISMATCH = "Output file extension '{suffix}' does not match requested format '{fmt}'"
REPLY_KEYS = ("document_title", "short_description", "short_summary", "full_summary")
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return strip_ws(_c(c))


def normalize_output(content, output_format) -> Column:
    """O1: strip; for json remove one code fence and pretty-print valid JSON
    (with a trailing newline), else keep the cleaned text."""
    cleaned = strip_text(content)
    unfenced = strip_text(strip_fence(cleaned))
    # only json rows reach the Python parser; the others send null
    pretty = json_pretty(F.when(_c(output_format) == "json", unfenced))["text"]
    as_json = F.when(pretty.isNotNull(), F.concat(pretty, F.lit("\n"))).otherwise(unfenced)
    return F.when(_c(output_format) == "json", as_json).otherwise(cleaned)


def json_reply(content) -> Column:
    """The json reply as columns: struct(document_title, short_description,
    short_summary, full_summary, status, error).

    The reply is stripped and one code fence removed, as for saving.  It is
    ``ok`` if it is a JSON object that has the four keys; a value that is no
    string is its JSON text, a further key is let be.  Otherwise the status is
    ``bad_reply`` and the error says what is wrong; keys that are there keep
    their values.  A null reply is ``bad_reply`` too.  Both feed ``degrade_errors``.
    """
    clean = strip_text(strip_fence(strip_text(content)))
    fields = ", ".join(f"{k} string" for k in REPLY_KEYS)
    read = F.from_json(clean, f"{fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    is_object = clean.startswith("{") & read.isNotNull() & read["_corrupt"].isNull()
    lacking = F.array_compact(F.array(*[F.when(read[k].isNull(), F.lit(k)) for k in REPLY_KEYS]))
    error = (F.when(clean.isNull() | (clean == ""), F.lit("the reply is empty"))
              .when(~F.coalesce(is_object, F.lit(False)), F.lit("the reply is not a JSON object"))
              .when(F.size(lacking) > 0, F.concat(F.lit("the reply lacks "), F.array_join(lacking, ", "))))
    return F.struct(*[F.when(is_object, read[k]).alias(k) for k in REPLY_KEYS],
                    F.when(error.isNull(), F.lit("ok")).otherwise(F.lit("bad_reply")).alias("status"), error.alias("error"))


def resolve_target(target, output_format) -> Column:
    """O2: struct(path, error).  No suffix: the format's is appended; another
    suffix (exact, case-sensitive compare) is an error."""
    t, fmt = _c(target), _c(output_format)
    name = F.regexp_extract(t, r"([^/]*)$", 1)
    sfx = F.regexp_extract(name, SUFFIX_PATTERN, 1)
    want = F.concat(F.lit("."), fmt)
    path = (F.when(t.isNull(), F.lit(None).cast("string"))
             .when(sfx == "", F.concat(t, want))
             .when(sfx == want, t))
    a, b, c = MSG_TARGET_MISMATCH.format(suffix="\0", fmt="\0").split("\0")
    err = F.when(t.isNotNull() & (sfx != "") & (sfx != want),
                 F.concat(F.lit(a), sfx, F.lit(b), fmt, F.lit(c)))
    return F.struct(path.alias("path"), err.alias("error"))


def write_summaries(df: DataFrame, path: str, fmt: str = "parquet",
                    partition_by: str | None = "output_format") -> None:
    """O3 (table form): one distributed write, partitioned by format."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)


WRITTEN, CONFLICT, FAILED = "written", "conflict", "failed"


def export_report(df: DataFrame, path_col: str = "target_path", text_col: str = "saved_content") -> DataFrame:
    """O3 (file form): write each row's text to its own file, from executors;
    ``(path, n_rows, status, error)`` per target.

    A file appears whole or not at all, and replaces an older one: a killed task
    leaves no half file, and its next attempt writes the same again.  Rows with
    the same target and text are one file; a target with different texts is a
    ``conflict``: reported, not written.  A file that cannot be written is
    ``failed``.  Missing folders are made.  Rows without a target or a text are
    left out.  Targets are paths or URIs on storage that every executor reaches
    (``sources/storage.py``).  The export runs at once; the report is a table in
    the scratch folder, so reading it writes nothing again.
    """
    spark = df.sparkSession
    rows = df.where(F.col(path_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(path_col).alias("path"), F.col(text_col).alias("t"))
    # one text a target, map-side first; its digests tell whether there were others
    one = rows.withColumn("d", F.sha2(F.col("t").cast("binary"), 256)).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("d").alias("low"), F.max("d").alias("high"), F.first("t").alias("t"))
    targets = one.select("path", "n_rows", (F.col("low") != F.col("high")).alias("conflict"),
                         F.when(F.col("low") == F.col("high"), F.col("t")).alias("t"))

    def write(batches):
        from docweave.sources.storage import Writer

        with Writer() as files:
            for pdf in batches:
                found = []
                for path, text, conflict in zip(pdf["path"], pdf["t"], pdf["conflict"]):
                    if conflict:
                        found.append((CONFLICT, "rows with different texts name this target"))
                        continue
                    try:
                        files.put(path, text.encode())
                        found.append((WRITTEN, None))
                    except (OSError, ValueError) as e:
                        found.append((FAILED, f"{type(e).__name__}: {e}"))
                out = pdf[["path", "n_rows"]].copy()
                out["status"], out["error"] = [f[0] for f in found], [f[1] for f in found]
                yield out

    # files take their time by number, not by size: dealt over all slots, where AQE would join small partitions
    slots = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    report = scratch_dir(spark, "export")
    schema = "path string, n_rows long, status string, error string"
    targets.repartition(slots, "path").mapInPandas(write, schema).write.parquet(report)
    return spark.read.schema(schema).parquet(report)


def export_files(df: DataFrame, path_col: str = "target_path", text_col: str = "saved_content") -> int:
    """``export_report`` in short: the number of files written."""
    return export_report(df, path_col, text_col).where(F.col("status") == WRITTEN).count()
