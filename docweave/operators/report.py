"""Loader report (G1): per-extension outcome of text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
PREVIEW_CHARS = 200
# -----------------------------------------------------------------------------


def extension_totals(texts: DataFrame, ext_col: str = "ext", path_col: str = "path") -> DataFrame:
    """Per-extension totals (batch or streaming input).

    ``n_files, n_ok, n_chars`` (characters of the extracted texts),
    ``preview`` (first 200 characters of the first ok file by path) and
    ``error_class`` / ``error`` of the first failing file by path.  Partial
    aggregation runs map-side.
    """
    ok = F.col("error_class").isNull()
    # min_by over strings is a sort-based aggregate: project the 200-char
    # preview and the length first, so the sort never carries whole texts
    slim = texts.select(
        F.col(ext_col), ok.alias("_ok"),
        F.when(ok, F.col(path_col)).alias("_ok_path"), F.when(~ok, F.col(path_col)).alias("_bad_path"),
        F.when(ok, F.char_length("text")).alias("_chars"),
        F.when(ok, F.substring("text", 1, PREVIEW_CHARS)).alias("_preview"),
        "error_class", "error")
    return slim.groupBy(ext_col).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("_ok").alias("n_ok"),
        F.coalesce(F.sum("_chars"), F.lit(0)).alias("n_chars"),
        F.min_by("_preview", "_ok_path").alias("preview"),
        F.min_by("error_class", "_bad_path").alias("error_class"),
        F.min_by("error", "_bad_path").alias("error"),
    )


def with_overall_flag(per_ext: DataFrame) -> DataFrame:
    """``all_ok``: true only if every file of every extension loaded: one
    partially aggregated row, joined to every extension's row (extensions come
    from the data, so their rows never meet in one task)."""
    overall = per_ext.agg(F.bool_and(F.col("n_ok") == F.col("n_files")).alias("all_ok"))
    return per_ext.crossJoin(F.broadcast(overall))


def loader_report(texts: DataFrame, ext_col: str = "ext", path_col: str = "path") -> DataFrame:
    """G1: one row per extension with its totals and the overall flag."""
    return with_overall_flag(extension_totals(texts, ext_col, path_col))
