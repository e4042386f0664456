"""Summary requests: allowed values (P2), validation (P1), option
resolution (P3-P5).

A request is one row; every option is nullable (null = not given):

    req_id long, doc_id long, use_model boolean, sentences int, effort string,
    output_format string, target string, desc_level int, sum_level int

Validation is a chain of ``when`` rules evaluated in the fixed order below,
so the first failing rule names the error.  Lookups against the three tiny
constant tables (models, levels) are literal maps - no join at all; the only
data-sized join is the document existence check, a left join on ``doc_id``
against the document keys (Parquet reads just that column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
EFFORTS = ("low", "mid", "high")
EFFORT_TO_MODEL = {
    "low": "gemini-2.5-flash-lite",
    "mid": "gemini-2.5-flash",
    "high": "gemini-2.5-pro",
}
DEFAULT_EFFORT = "mid"
OUTPUT_FORMATS = ("txt", "md", "json")
DEFAULT_OUTPUT = "txt"
SENTENCES_MIN, SENTENCES_MAX, DEFAULT_SENTENCES = 1, 250, 5
LEVEL_MIN, LEVEL_MAX, DEFAULT_LEVEL = 1, 3, 2
DEFAULT_MAX_RETRIES = 3
DEFAULT_INITIAL_DELAY = 1.0
DESCRIPTION_LEVELS = {
    1: "Provide a concise description of the given text.",
    2: "Provide a detailed description of the given text.",
    3: "Provide an in-depth and very detailed description of the given text.",
}
SUMMARY_LEVELS = {
    1: "The summary should be concise, but still fit into the sentences cap",
    2: "The summary should be detailed, but still fit into the sentences cap",
    3: "The summary should be very detailed and in-depth, but still fit into the sentences cap",
}
MSG_NOT_FOUND = "File not found: {doc}"
MSG_SENTENCES_RANGE = "Sentences cannot be less than {lo} and more than {hi}! Current amount: {n}"
MSG_DESC_RANGE = "Description level must be between {lo} and {hi}. Got: {n}"
MSG_SUM_RANGE = "Summary level must be between {lo} and {hi}. Got: {n}"
# ------------------------------------------------------------------------------

REQUEST_SCHEMA = ("req_id long, doc_id long, use_model boolean, sentences int, effort string, "
                  "output_format string, target string, desc_level int, sum_level int")


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _message(template: str, n: Column, **fixed) -> Column:
    """A fixed message with the value ``n`` filled in on the JVM side."""
    head, tail = template.format(n="\0", **fixed).split("\0")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def _needs_model(option: str) -> str:
    return f"{option} requires use_model and only works with the model route"


def check_allowed_values(req: DataFrame) -> DataFrame:
    """Effort and output_format must be known values (null = not given)."""
    eff, out = F.col("effort"), F.col("output_format")
    bad = (F.when(eff.isNotNull() & ~eff.isin(*EFFORTS), F.concat(
               F.lit("invalid effort value: '"), eff, F.lit(f"' (choose from {', '.join(EFFORTS)})")))
            .when(out.isNotNull() & ~out.isin(*OUTPUT_FORMATS), F.concat(
               F.lit("invalid output_format value: '"), out,
               F.lit(f"' (choose from {', '.join(OUTPUT_FORMATS)})"))))
    return (req.withColumn("error", bad)
               .withColumn("error_class", F.when(bad.isNotNull(), F.lit("invalid_value"))))


def validation_error(doc_exists: Column) -> Column:
    """P1 rules in order; null when the request is valid."""
    model = F.coalesce(F.col("use_model"), F.lit(False))
    s, dl, sl = F.col("sentences"), F.col("desc_level"), F.col("sum_level")

    def out_of(c, lo, hi):
        return c.isNotNull() & ((c < lo) | (c > hi))

    return (
        F.when(~doc_exists, _message(MSG_NOT_FOUND.replace("{doc}", "{n}"), F.col("doc_id")))
        .when(s.isNotNull() & ~model, F.lit(_needs_model("sentences")))
        .when(out_of(s, SENTENCES_MIN, SENTENCES_MAX),
              _message(MSG_SENTENCES_RANGE, s, lo=SENTENCES_MIN, hi=SENTENCES_MAX))
        .when(F.col("effort").isNotNull() & ~model, F.lit(_needs_model("effort")))
        .when(F.col("target").isNotNull() & ~model, F.lit(_needs_model("target")))
        .when(F.col("output_format").isNotNull() & (F.col("output_format") != DEFAULT_OUTPUT) & ~model,
              F.lit(_needs_model("output_format")))
        # an explicit level 0 skips the route rule and fails the range rule
        .when(dl.isNotNull() & (dl != 0) & ~model, F.lit(_needs_model("desc_level")))
        .when(out_of(dl, LEVEL_MIN, LEVEL_MAX), _message(MSG_DESC_RANGE, dl, lo=LEVEL_MIN, hi=LEVEL_MAX))
        .when(sl.isNotNull() & (sl != 0) & ~model, F.lit(_needs_model("sum_level")))
        .when(out_of(sl, LEVEL_MIN, LEVEL_MAX), _message(MSG_SUM_RANGE, sl, lo=LEVEL_MIN, hi=LEVEL_MAX))
    )


def requested_documents(requests: DataFrame, docs: DataFrame, key: str = "_dk",
                        max_ids: int | None = None) -> DataFrame:
    """Documents that some request names, filtered *before* any shuffle.

    Off by default (``max_ids=None``): building a plan starts no job, and the
    main join does the work.  A caller with few requests against a large corpus
    can give ``max_ids``: the distinct requested ids are then counted at once,
    and broadcast for a left-semi join if there are at most that many (and they
    name at most half of the documents).
    """
    if not max_ids:
        return docs
    ids = requests.select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    n_ids = ids.count()
    if n_ids > max_ids:
        return docs
    # when most documents are requested anyway, filtering saves little
    if 2 * n_ids > docs.select(key).count():
        return docs
    return docs.join(F.broadcast(ids), key, "left_semi")


def validate_requests(req: DataFrame, doc_keys: DataFrame | None = None,
                      key: str = "doc_id") -> DataFrame:
    """P2 then P1.  Adds ``error_class`` (``invalid_value`` / ``rejected``)
    and ``error``; valid rows have both null.  ``doc_keys`` holds the known
    document keys (one column ``key``); missing documents are rejected.
    """
    checked = check_allowed_values(req)
    if doc_keys is None:
        exists = F.lit(True)
        joined = checked
    else:
        # only the keys some request names (size-checked broadcast), then distinct
        keys = requested_documents(req, doc_keys.select(F.col(key).alias("_k")), "_k")
        present = keys.distinct().withColumn("_present", F.lit(True))
        joined = checked.join(present, checked[key] == present["_k"], "left").drop("_k")
        exists = F.coalesce(F.col("_present"), F.lit(False))
    rule = validation_error(exists)
    out = joined.select(
        *[c for c in checked.columns if c not in ("error", "error_class")],
        F.coalesce(F.col("error_class"), F.when(rule.isNotNull(), F.lit("rejected"))).alias("error_class"),
        F.coalesce(F.col("error"), rule).alias("error"))
    return out


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected requests as two DataFrames."""
    ok = F.col("error_class").isNull()
    return validated.where(ok), validated.where(~ok)


def resolve_model(effort: Column, config_model: str | None = None) -> Column:
    """Explicit effort > configured model > default effort's model."""
    mapped = _lit_map(EFFORT_TO_MODEL)[effort]
    fallback = F.lit(config_model) if config_model else F.lit(EFFORT_TO_MODEL[DEFAULT_EFFORT])
    return F.coalesce(mapped, fallback)


# job configuration keys read from the Spark conf (the cluster's "environment")
CONF_KEYS = {
    "model": ("spark.docweave.model", str),
    "max_retries": ("spark.docweave.maxRetries", int),
    "sentences": ("spark.docweave.sentences", int),
    "output_format": ("spark.docweave.outputFormat", str),
    "desc_level": ("spark.docweave.descLevel", int),
    "sum_level": ("spark.docweave.sumLevel", int),
}


def config_from_session(spark) -> dict:
    """Job-level defaults from ``spark.docweave.*`` conf keys (unset keys are
    left out, so built-in defaults apply)."""
    out = {}
    for name, (key, cast) in CONF_KEYS.items():
        value = spark.conf.get(key, None)
        if value not in (None, ""):
            out[name] = cast(value)
    return out


def resolve_options(req: DataFrame, config: dict | None = None) -> DataFrame:
    """Fill every option: explicit value > job config > default.

    ``config`` is a small dict (the job's environment); its values become
    literals in the plan.
    """
    cfg = config or {}

    def pick(col: str, key: str, default):
        return F.coalesce(F.col(col), F.lit(cfg.get(key, default)))

    return req.select(
        *[c for c in req.columns if c not in
          ("sentences", "output_format", "desc_level", "sum_level")],
        resolve_model(F.col("effort"), cfg.get("model")).alias("model"),
        pick("sentences", "sentences", DEFAULT_SENTENCES).cast("int").alias("sentences"),
        pick("output_format", "output_format", DEFAULT_OUTPUT).alias("output_format"),
        pick("desc_level", "desc_level", DEFAULT_LEVEL).cast("int").alias("desc_level"),
        pick("sum_level", "sum_level", DEFAULT_LEVEL).cast("int").alias("sum_level"),
        F.lit(int(cfg.get("max_retries", DEFAULT_MAX_RETRIES))).alias("max_retries"),
    )


def level_instruction(level: Column, table: dict) -> Column:
    """P5: level -> instruction; unknown level -> level 2's."""
    return F.coalesce(_lit_map(table)[level], F.lit(table[DEFAULT_LEVEL]))


def resolve_levels(req: DataFrame) -> DataFrame:
    return (req.withColumn("desc_instruction", level_instruction(F.col("desc_level"), DESCRIPTION_LEVELS))
               .withColumn("sum_instruction", level_instruction(F.col("sum_level"), SUMMARY_LEVELS)))


def requests_from_orders(orders: DataFrame) -> DataFrame:
    """Derive a request table from ``orders`` (test and bench workload).

    Each order is one request for document ``o_custkey``; options are a
    deterministic function of the order, covering valid and invalid values.
    """
    k = F.col("o_orderkey")
    prio = F.col("o_orderpriority")
    return orders.select(
        k.alias("req_id"),
        F.col("o_custkey").alias("doc_id"),
        (k % 4 != 0).alias("use_model"),
        F.when(k % 5 == 0, (k % 300 - 20)).cast("int").alias("sentences"),
        F.when(prio.startswith("1"), F.lit("high")).when(prio.startswith("2"), F.lit("mid"))
         .when(prio.startswith("5"), F.lit("low")).when(prio.startswith("4"), F.lit("max"))
         .alias("effort"),
        F.when(F.col("o_orderstatus") == "O", F.lit("md")).when(F.col("o_orderstatus") == "P", F.lit("json"))
         .when(k % 97 == 0, F.lit("pdf")).alias("output_format"),
        F.when(k % 11 == 0, F.concat(F.lit("out/s_"), k.cast("string"), F.lit(".md")))
         .when(k % 11 == 1, F.concat(F.lit("out/s_"), k.cast("string"))).alias("target"),
        F.when(k % 6 == 0, (k % 5)).cast("int").alias("desc_level"),
        F.when(k % 7 == 0, (k % 4)).cast("int").alias("sum_level"),
    )
