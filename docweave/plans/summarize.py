"""M5: route every request to the local or the model summary.

Plan shape:

    requests -> P2/P1 rules that need no document, P3-P5 options, O2 target
      -> an ask per request: (document, what is wanted of it, its options)
    distinct asks (small rows, pre-aggregated) LEFT JOIN documents(doc_id, text)
      -> local asks: T6 summary (JVM); model asks: M1 prompt (JVM)
      -> M2 mapInPandas where the join left the rows: one call per ask; the text
         ends here
    requests LEFT JOIN answered asks, by a 128-bit digest of the ask
      -> P1 with the document's existence, route = rejected | failed (the
         document did not load) | local | model; M4 degrade, O1 normalise

Two joins, the corpus in one of them; texts and prompts move once.  A document
requested by a third of all requests with the same options is one ask.  Nothing
is dropped: every request comes out once with its route and status.  Building
the plan starts no job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import local_summary, shorten_title
from docweave.operators import inference as M
from docweave.operators.output import normalize_output, resolve_target
from docweave.session import ensure_checkpoint_dir
from docweave.sources.formats import stem
from docweave.operators.requests import (
    check_allowed_values, config_from_session, requested_documents, resolve_levels,
    resolve_options, validation_error)

OUT_COLS = ["req_id", "doc_id", "route", "output_format", "content", "saved_content",
            "target_path", "attempts", "status", "error_class", "error"]


def prepare_requests(requests: DataFrame, documents: DataFrame, config: dict | None = None,
                     doc_key: str = "doc_id", text_col: str = "text",
                     prefilter_max_ids: int | None = None,
                     name_col: str | None = None) -> DataFrame:
    """Validated, resolved requests with the document text (``_text``),
    ``route`` and the checked target (``_t``: struct(path, error)).

    ``documents`` must be unique on ``doc_key``; one join, with the text on every
    row.  ``summarize`` itself joins distinct asks instead.
    """
    if config is None:  # explicit request value > job conf > built-in default
        config = config_from_session(requests.sparkSession)
    docs = _documents(documents, doc_key, text_col, name_col)
    docs = requested_documents(requests, docs, "_dk", prefilter_max_ids)
    checked = check_allowed_values(requests)
    joined = checked.join(docs, checked["doc_id"] == docs["_dk"], "left")
    rule = validation_error(F.col("_dk").isNotNull())
    validated = joined.select(
        *[c for c in checked.columns if c not in ("error", "error_class")], "_text", "_xclass", "_xerror",
        *(["_name"] if name_col else []),
        F.coalesce(F.col("error_class"), F.when(rule.isNotNull(), F.lit("rejected"))).alias("error_class"),
        F.coalesce(F.col("error"), rule).alias("error"))
    resolved = resolve_levels(resolve_options(
        validated.withColumn("_format_given", F.col("output_format")), config))
    route = (F.when(F.col("error_class").isNotNull(), F.lit("rejected"))
              .when(F.col("_xclass").isNotNull(), F.lit("failed"))
              .when(F.coalesce(F.col("use_model"), F.lit(False)), F.lit("model"))
              .otherwise(F.lit("local")))
    return (resolved.withColumn("route", route)
                    .withColumn("_t", F.when(F.col("route") == "model",
                                             resolve_target("target", "output_format"))))


def _documents(documents: DataFrame, doc_key: str, text_col: str, name_col: str | None) -> DataFrame:
    """(_dk, _text, _xclass, _xerror): a document that failed to load keeps its
    error - no call, no summary."""
    text = F.col(text_col)
    failed = [F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in ("error_class", "error")]
    return documents.select(
        F.col(doc_key).alias("_dk"), text.alias("_text"), *([F.col(name_col).alias("_name")] if name_col else []),
        F.coalesce(failed[0], F.when(text.isNull(), F.lit("no_text"))).alias("_xclass"),
        F.coalesce(failed[1], F.when(text.isNull(), F.lit("the document has no text"))).alias("_xerror"))


def _asks(requests: DataFrame, config: dict | None, dedupe: bool) -> tuple[DataFrame, DataFrame]:
    """The requests with their options and the digest of what they ask for, and
    the distinct asks.  A request that fails a rule, or whose target is wrong,
    asks only whether the document exists and loads."""
    if config is None:  # explicit request value > job conf > built-in default
        config = config_from_session(requests.sparkSession)
    checked = check_allowed_values(requests)
    ruled = checked.withColumns({"_bad": F.coalesce(F.col("error"), validation_error(F.lit(True)))}).select(
        *[c for c in requests.columns], F.col("error_class").alias("_bad_class"), F.col("error").alias("_own"), "_bad")
    options = ("sentences", "output_format", "desc_level", "sum_level")
    resolved = resolve_levels(resolve_options(ruled.withColumns({f"_{c}_given": F.col(c) for c in options}), config))
    fine, model = F.col("_bad").isNull(), F.coalesce(F.col("use_model"), F.lit(False))
    resolved = resolved.withColumn("_t", F.when(fine & model, resolve_target("target", "output_format")))
    want = F.when(~fine, F.lit(None).cast("string")).when(~model, F.lit("local")).when(F.col("_t.error").isNull(), F.lit("model"))
    asking = ["model", "max_retries", "output_format", "sentences", "desc_instruction", "sum_instruction"]
    ask = F.struct(F.col("doc_id").alias("_doc"), want.alias("_want"),
                   *[F.when(want == "model", F.col(c)).alias(c) for c in asking],
                   *([] if dedupe else [F.col("req_id")]))
    asked = resolved.withColumn("_a", ask).withColumn("_ask", F.md5(F.to_json("_a").cast("binary")))
    asks = asked.select("_ask", "_a").dropDuplicates(["_ask"]).select(
        "_ask", *[F.col(f"_a.{c}").alias(c) for c in ("_doc", "_want", *asking)])
    kept = asked.select("req_id", "doc_id", "use_model", "effort", "target", "_bad_class", F.col("_own").alias("_bad"),
                        *[F.col(f"_{c}_given").alias(c) for c in options], F.col("output_format").alias("_format"),
                        F.col("_t.path").alias("target_path"), F.col("_t.error").alias("_terror"), "_ask")
    return kept, asks


def summarize(requests: DataFrame, documents: DataFrame, make_provider: Callable | None = None,
              config: dict | None = None, doc_key: str = "doc_id", text_col: str = "text",
              partitions: int | None = None, initial_delay: float = 1.0,
              sleep: Callable[[float], None] | None = None, provider_name: str = "Model",
              materialize: bool = False,
              prefilter_max_ids: int | None = None,
              name_col: str | None = None, dedupe_calls: bool = True,
              ledger: M.ReplyLedger | None = None) -> DataFrame:
    """Summaries for a request table against a document table.

    ``documents`` must be unique on ``doc_key``.  ``dedupe_calls`` answers each
    distinct ask (document and options) once and shares the reply among the
    requests that make it; without it every request is an ask of its own.

    With ``name_col`` (the documents' file names) the result also carries
    ``name`` and ``title`` (the stem with ``_``/``-`` as spaces).

    ``materialize`` checkpoints the replies into the cluster's checkpoint
    folder so that later actions never call the provider again.  ``ledger``
    keeps each reply as it is paid for, through lost tasks and failed jobs, and
    spares later jobs the prompts it holds.
    """
    spark = requests.sparkSession
    if make_provider is None:
        make_provider = M.LeadProvider()
    asked, asks = _asks(requests, config, dedupe_calls)
    slots = int(partitions or M.provider_slots(spark))
    docs = requested_documents(requests, _documents(documents, doc_key, text_col, name_col), "_dk", prefilter_max_ids)
    # a caller who gives as many partitions as a bucketed corpus has buckets moves no text at all
    met = asks.repartition(slots, "_doc").join(docs, F.col("_doc") == F.col("_dk"), "left")
    loaded = F.col("_dk").isNotNull() & F.col("_xclass").isNull()
    prepared = met.select(
        "_ask", F.col("_dk").isNotNull().alias("_exists"), "_xclass", "_xerror", *(["_name"] if name_col else []),
        F.when(loaded & (F.col("_want") == "local"), local_summary("_text")).alias("_local"),
        F.when(loaded & (F.col("_want") == "model"), M.build_prompt("_text")).alias("prompt"), "model", "max_retries")
    carried = ("_exists", "_xclass", "_xerror", "_local") + (("_name",) if name_col else ())
    answers = M.infer_batch(prepared, make_provider, key_cols=("_ask",), carry_cols=carried, deal=False,
                            partitions=partitions, initial_delay=initial_delay, sleep=sleep,
                            pass_null_prompts=True, ledger=ledger)
    if materialize:
        # reliable checkpoint into the cluster's shared folder (never local)
        ensure_checkpoint_dir(spark)
        answers = answers.checkpoint(eager=True)
        if ledger is not None:
            ledger.settle(spark)
    joined = asked.join(answers, "_ask", "left")
    rule = validation_error(F.col("_exists"))
    called = joined.withColumns({
        "_vclass": F.coalesce("_bad_class", F.when(rule.isNotNull(), F.lit("rejected"))),
        "_verror": F.coalesce(F.col("_bad"), rule)})
    called = called.withColumns({
        "route": F.when(F.col("_vclass").isNotNull(), F.lit("rejected")).when(F.col("_xclass").isNotNull(), F.lit("failed"))
                  .when(F.coalesce(F.col("use_model"), F.lit(False)), F.lit("model")).otherwise(F.lit("local")),
        "_vclass": F.coalesce("_vclass", "_xclass"), "_verror": F.coalesce("_verror", "_xerror")})
    # a rejected request reports the format it asked for, not the default
    called = called.withColumn("output_format", F.when(F.col("route") == "rejected", F.col("output_format")).otherwise(F.col("_format")))
    if name_col:
        called = called.withColumn("_title", shorten_title(stem("_name")))

    route, null_s = F.col("route"), F.lit(None).cast("string")
    st = F.col("status")
    is_model_call = (route == "model") & F.col("_terror").isNull()
    refused = route.isin("rejected", "failed")
    status = (F.when(refused, route)
               .when(route == "local", F.lit(M.OK))
               .when(F.col("_terror").isNotNull(), F.lit(M.CONFIG_ERROR))
               .otherwise(st))
    content = (F.when(route == "local", F.col("_local"))
                .when(route == "model", F.when(F.col("_terror").isNotNull(), M.degrade_errors(
                    F.lit(M.CONFIG_ERROR), null_s, F.col("_terror"), provider_name))
                    .otherwise(M.degrade_errors("status", "content", "error", provider_name))))
    to_save = is_model_call & (st == M.OK) & F.col("target_path").isNotNull()
    saved = F.when(to_save, normalize_output(F.when(to_save, F.col("content")), "output_format"))
    error_class = (F.when(refused, F.col("_vclass"))
                    .when(F.col("_terror").isNotNull(), F.lit(M.CONFIG_ERROR))
                    .when(is_model_call & (st != M.OK), st))
    error = (F.when(refused, F.col("_verror"))
              .when(F.col("_terror").isNotNull(), F.col("_terror"))
              .when(is_model_call, F.col("error")))
    named = [F.col("_name").alias("name"), F.col("_title").alias("title")] if name_col else []
    return called.select(
        "req_id", "doc_id", *named, "route", "output_format", content.alias("content"),
        saved.alias("saved_content"),
        F.when(is_model_call, F.col("target_path")).alias("target_path"),
        F.when(is_model_call, F.col("attempts")).otherwise(F.lit(0)).alias("attempts"),
        status.alias("status"), error_class.alias("error_class"), error.alias("error"))
