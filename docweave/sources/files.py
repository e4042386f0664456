"""Files in, text out: S1 read_corpus, S3 decode_text, U1 user extractors,
and the per-format dispatch that turns routed rows into text.

Files are listed and read on the executors, one row per file (``sources/listing.py``).
Extraction is one projection over the routed rows: every format's rule is a
branch of one ``CASE`` (only the taken branch runs for JVM rules); the Python
helpers receive null for rows of other formats, so each row is parsed once.
Nothing is ever raised: a bad row carries ``error_class`` and ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.html import join_text_nodes, mark_text_nodes, shown, unescape_one
from docweave.functions.jsontext import pretty_one, safe_text
from docweave.operators.structured import LARGE_NOTEBOOK, _notebook_text, csv_head, notebook_text_one, xml_outline_one
from docweave.session import bound_batches
from docweave.sources.formats import FORMATS, route_by_extension
from docweave.sources.listing import empty_files, listed_files
from docweave.sources.listing import with_content as read_content
from docweave.sources.storage import check_paths

TEXT_SCHEMA = "path string, name string, stem string, ext string, kind string, text string, " \
              "error_class string, error string"


# the longest value a Spark binary column can hold; nothing smaller is cut off
DEFAULT_MAX_BYTES = (1 << 31) - 16


def read_corpus(spark: SparkSession, paths, glob: str | None = None, recursive: bool = True,
                wanted: list[str] | None = None, include_empty: bool = True,
                max_bytes: int | None = DEFAULT_MAX_BYTES, with_content: bool = True) -> DataFrame:
    """``(path, modificationTime, length, content, error_class, error)``
    per file.

    ``wanted`` lists paths the caller expects; those not found come back as
    rows with null content and ``error_class='not_found'`` (left-anti join of
    the wanted paths against the listing).  Folders are listed and files read on
    the executors (``sources/listing.py``), files of no length too; the driver
    holds no list of them.  ``with_content=False`` leaves ``content`` null and
    opens no file.  ``include_empty=False`` leaves out files of no length, for a
    store that only Spark's own readers can open; that, ``recursive=False`` and a
    ``max_bytes`` of the caller's is a ``binaryFile`` scan, listed on the driver.
    Files over ``max_bytes`` are not read: they come back as ``too_large`` rows
    (there from a metadata-only scan), so one huge file cannot fail the job.
    """
    # only local paths have several spellings; other schemes are compared as they are
    canon = lambda c: F.when(c.rlike("^(file:|/)"), F.regexp_replace(c, "^(file:)?/*", "file:/")).otherwise(c)
    if include_empty and recursive and max_bytes == DEFAULT_MAX_BYTES:
        check_paths(spark, paths)
        listed = listed_files(spark, paths, glob)
        got = listed.select(canon(F.col("path")).alias("path"))
        files = read_content(listed, max_bytes) if with_content else listed.withColumn("content", F.lit(None).cast("binary"))
        large = F.col("length") > max_bytes
        files = files.withColumns({
            "error_class": F.when(large, F.lit("too_large")),
            "error": F.when(large, F.concat(F.lit(f"File is larger than {max_bytes} bytes: "), F.col("length").cast("string")))})
    else:
        files = _scanned_files(spark, paths, glob, recursive, include_empty, max_bytes)
        got = files.select(canon(F.col("path")).alias("path"))
    if wanted:
        want = spark.createDataFrame([(p,) for p in wanted], "path string") \
            .withColumn("path", canon(F.col("path")))
        missing = want.join(got, "path", "left_anti").select(
            "path", F.lit(None).cast("timestamp").alias("modificationTime"),
            F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"),
            F.lit("not_found").alias("error_class"),
            F.concat(F.lit("File not found: "), F.col("path")).alias("error"))
        files = files.unionByName(missing)
    return files


def _scanned_files(spark: SparkSession, paths, glob: str | None, recursive: bool, include_empty: bool,
                   max_bytes: int | None) -> DataFrame:
    """``read_corpus`` by Spark's own reader, which lists on the driver."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listing = reader.load(paths if isinstance(paths, str) else list(paths))
    scanned = listing.where(F.col("length") <= max_bytes) if max_bytes else listing
    files = scanned.withColumn("error_class", F.lit(None).cast("string")).withColumn(
        "error", F.lit(None).cast("string"))
    if max_bytes:
        too_large = listing.where(F.col("length") > max_bytes).select(
            "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"),
            F.lit("too_large").alias("error_class"),
            F.concat(F.lit(f"File is larger than {max_bytes} bytes: "),
                     F.col("length").cast("string")).alias("error"))
        files = files.unionByName(too_large)
    if include_empty:
        empty = empty_files(spark, paths, glob, recursive).withColumns(
            {"error_class": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        files = files.unionByName(empty)
    return files


def decode_text(content, fold_newlines: bool = True) -> Column:
    """S3: UTF-8 with replacement of bad bytes; ``\\r\\n`` and ``\\r`` -> ``\\n``."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.make_valid_utf8(c.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n") if fold_newlines else text


def _custom_udf(extractors: dict[str, Callable[[bytes], str]]):
    table = dict(extractors)

    @F.pandas_udf(_TEXT_ERROR)
    def run(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for e, b in zip(ext, content):
            fn = table.get(e) if e is not None else None
            if fn is None or b is None:
                texts.append(None)
                errors.append(None)
                continue
            try:
                got = fn(bytes(b))
                if not isinstance(got, str):
                    raise TypeError(f"extractor returned {type(got).__name__}, not str")
                texts.append(safe_text(got))
                errors.append(None)
            except Exception as exc:  # noqa: BLE001 - quarantine, never fail
                texts.append(None)
                errors.append(safe_text(f"{type(exc).__name__}: {exc}"))
        return pd.DataFrame({"text": texts, "error": errors})

    return run


_TEXT_ERROR = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_TEXT_ERROR)
def _extract_py(kind: pd.Series, payload: pd.Series) -> pd.DataFrame:
    """The Python half of every built-in format, one Arrow hop per row."""
    texts, errors = [], []
    for k, v in zip(kind, payload):
        t = e = None
        if v is not None:
            if k == "html":
                t = safe_text(unescape_one(shown(v)))
            elif k == "json":
                t, e = pretty_one(v)
            elif k == "csv":
                t, e = csv_head(v)
            elif k == "xml":
                t = xml_outline_one(v)
            elif k == "notebook":
                t, e = notebook_text_one(v)
        texts.append(t)
        errors.append(e)
    return pd.DataFrame({"text": texts, "error": errors})


def extract_text(routed: DataFrame, content_col: str = "content",
                 extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Per-format text of routed rows (output of ``route_by_extension``).

    ``content_col`` may be binary (files) or string (text already in a
    table).  Returns ``TEXT_SCHEMA`` columns plus any key columns kept by the
    caller.
    """
    bound_batches(routed.sparkSession)
    custom = {k.lower(): v for k, v in (extractors or {}).items()}
    ctype = dict(routed.dtypes)[content_col]
    raw_bytes = F.col(content_col) if ctype == "binary" else F.col(content_col).cast("binary")
    unfolded = decode_text(raw_bytes, fold_newlines=False) if ctype == "binary" else F.col(content_col)
    folded = F.regexp_replace(unfolded, "\r\n?", "\n")
    kind, ext = F.col("kind"), F.col("ext")

    is_custom = ext.isin(*custom.keys()) if custom else F.lit(False)
    if custom:
        cust = _custom_udf(custom)(F.when(is_custom & F.col("error_class").isNull(), ext),
                                   F.when(is_custom & F.col("error_class").isNull(), raw_bytes))
        cust_text, cust_err = cust["text"], cust["error"]
    else:
        cust_text = cust_err = F.lit(None).cast("string")
    # errors found earlier (missing file, unknown type) win; routing never
    # flags an extension that has a user extractor
    pre_error = F.col("error_class").isNotNull()
    large = F.char_length(folded) > LARGE_NOTEBOOK  # beyond what the JVM's JSON reader takes
    # JVM pre-pass per format, then one Python call for all of them
    payload = (F.when(pre_error | is_custom, F.lit(None).cast("string"))
                .when(kind == "html", mark_text_nodes(folded))
                .when(kind.isin("json", "xml"), folded)
                .when((kind == "notebook") & large, folded)
                .when(kind == "csv", unfolded))
    py = _extract_py(kind, payload)  # struct(text, error)
    # a notebook must be a JSON object (VARIANT parse is JVM-side)
    small = F.when((kind == "notebook") & ~large, folded)
    nb_bad = (kind == "notebook") & ~is_custom & F.when(large, py["error"].isNotNull()).otherwise(
        F.try_parse_json(small).isNull() | ~small.rlike(r"^[ \t\n\r]*\{"))
    json_bad = (kind == "json") & ~is_custom & py["error"].isNotNull()
    csv_bad = (kind == "csv") & ~is_custom & py["error"].isNotNull()
    text = (F.when(pre_error, F.lit(None).cast("string"))
             .when(is_custom, cust_text)
             .when(kind == "text", folded)
             .when(kind == "html", join_text_nodes(py["text"]))
             .when(kind == "json", py["text"])
             .when(kind == "xml", py["text"])
             .when(kind == "csv", py["text"])
             .when(nb_bad, F.lit(None).cast("string"))
             .when((kind == "notebook") & large, py["text"])
             .when(kind == "notebook", _notebook_text(small)))
    err_class = (F.when(pre_error, F.col("error_class"))
                  .when(is_custom & cust_err.isNotNull(), F.lit("extractor_error"))
                  .when(json_bad | nb_bad, F.lit("bad_json"))
                  .when(csv_bad, F.lit("bad_csv")))
    err = (F.when(pre_error, F.col("error"))
            .when(is_custom & cust_err.isNotNull(), cust_err)
            .when(json_bad | csv_bad, py["error"])
            .when(nb_bad, F.lit("notebook is not a JSON object")))
    keep = [c for c in routed.columns if c not in
            ("content", content_col, "suffix", "has_extractor", "error_class", "error",
             "modificationTime", "length", "text")]
    return routed.select(*keep, text.alias("text"), err_class.alias("error_class"), err.alias("error"))


def load_corpus_text(files: DataFrame, path_col: str = "path", content_col: str = "content",
                     extractors: dict[str, Callable[[bytes], str]] | None = None,
                     formats=FORMATS) -> DataFrame:
    """S1 -> S2 -> extraction in one plan: one row per file with its text."""
    routed = route_by_extension(files, path_col, formats, extra=extractors)
    return extract_text(routed, content_col, extractors)


__all__ = ["read_corpus", "decode_text", "extract_text", "load_corpus_text"]
