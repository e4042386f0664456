"""The format registry as a small dimension DataFrame, and S2 routing.

Routing is a broadcast left join of the lower-cased suffix against the
registry (17 rows, fixed size - safe to broadcast at any data scale).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: registered extensions and the extractor kind of each ----
# (extension, kind, has_extractor).  has_extractor=False means the format is
# registered but its codec is not part of this engine; a user extractor can be
# supplied for it (see sources.files.read_corpus(extractors=...)).
FORMATS = [
    (".cpp", "text", True),
    (".csv", "csv", True),
    (".docx", "docx", False),
    (".html", "html", True),
    (".ipynb", "notebook", True),
    (".java", "text", True),
    (".js", "text", True),
    (".json", "json", True),
    (".md", "text", True),
    (".pdf", "pdf", False),
    (".pptx", "pptx", False),
    (".py", "text", True),
    (".txt", "text", True),
    (".xlsx", "xlsx", False),
    (".xml", "xml", True),
    (".yaml", "yaml", False),
    (".yml", "yaml", False),
]
MISSING_DEPENDENCY_HINT = {
    kind: f"No built-in extractor for {kind} files: pass your own as extractors= to load_corpus_text"
    for kind in ("docx", "pdf", "pptx", "xlsx", "yaml")
}
MSG_UNSUPPORTED = "Unsupported file type: {suffix}. Supported: {supported}"
# -----------------------------------------------------------------------------

# Python's pathlib suffix: text from the last dot, if that dot is neither the
# first nor the last character of the file name.
SUFFIX_PATTERN = r"(?s)^.+(\.[^.]+)$"
NAME_PATTERN = r"([^/]*)$"


def supported_list(formats=FORMATS) -> str:
    return ", ".join(sorted(ext for ext, _, _ in formats))


def formats_frame(spark: SparkSession, formats=FORMATS, extra: dict | None = None) -> DataFrame:
    rows = {ext: (ext, kind, has) for ext, kind, has in formats}
    for ext in (extra or {}):
        rows[ext] = (ext, "custom", True)
    # a VALUES relation stays in the JVM (no Python worker round trip)
    values = ", ".join(f"({_sql_str(e)}, {_sql_str(k)}, {str(h).lower()})"
                       for e, k, h in sorted(rows.values()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS f(ext, kind, has_extractor)")


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def file_name(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, NAME_PATTERN, 1)


def suffix(name) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(n, SUFFIX_PATTERN, 1)


def stem(name) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(n)))


def route_by_extension(df: DataFrame, path_col: str = "path", formats=FORMATS,
                       extra: dict | None = None) -> DataFrame:
    """Add ``name, stem, ext, kind`` and error columns.

    ``error_class`` is ``unsupported_type`` for an unknown suffix and
    ``missing_dependency`` for a registered format without a codec here.
    Rows are never dropped; callers split on ``error_class``.
    """
    spark = df.sparkSession
    fmt = formats_frame(spark, formats, extra)
    listed = supported_list([(e, k, h) for e, k, h in formats] +
                            [(e, "custom", True) for e in (extra or {})
                             if e not in {f[0] for f in formats}])
    hints = F.create_map(*[x for k, v in MISSING_DEPENDENCY_HINT.items()
                           for x in (F.lit(k), F.lit(v))])
    named = (df.withColumn("name", file_name(path_col))
               .withColumn("suffix", suffix("name"))
               .withColumn("stem", stem("name"))
               .withColumn("ext", F.lower("suffix")))
    joined = named.join(F.broadcast(fmt), "ext", "left")
    err_class = (F.when(F.col("kind").isNull(), F.lit("unsupported_type"))
                  .when(~F.col("has_extractor"), F.lit("missing_dependency")))
    head, tail = MSG_UNSUPPORTED.format(suffix="\0", supported=listed).split("\0")
    err = (F.when(F.col("kind").isNull(), F.concat(F.lit(head), F.col("suffix"), F.lit(tail)))
            .when(~F.col("has_extractor"), hints[F.col("kind")]))
    if "error_class" in df.columns:  # errors found earlier (missing file) win
        err_class = F.when(F.col("error_class").isNotNull(), F.col("error_class")).otherwise(err_class)
        err = F.when(F.col("error_class").isNotNull(), F.col("error")).otherwise(err)
    return joined.withColumn("error", err).withColumn("error_class", err_class)
