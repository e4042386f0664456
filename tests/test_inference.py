"""M1-M5 with deterministic providers (no network)."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.operators import inference as M
from docweave.operators.output import export_files, normalize_output, resolve_target
from docweave.operators.requests import DESCRIPTION_LEVELS, SUMMARY_LEVELS
from docweave.plans.summarize import summarize


# the fake providers below run on executors: ship this module by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Reply:
    def __init__(self, text):
        self.text = text


class NoText:
    pass


def _script(replies):
    """Provider that plays back a list of replies/exceptions per call."""
    def factory():
        seq = list(replies)

        def call(prompt, model):
            item = seq.pop(0)
            if isinstance(item, Exception):
                raise item
            return item
        return call
    return factory


def test_retry_then_success_and_backoff():
    delays = []
    f = _script([RuntimeError("Server error"), RuntimeError("Client error"), Reply("Successful summary.")])
    out = M.call_with_retry(f(), "p", "m", 3, 1.0, delays.append)
    assert out == ("Successful summary.", 3, M.OK, None)
    assert delays == [1.0, 2.0]


def test_exhausted_retries_message():
    delays = []
    f = _script([RuntimeError("Persistent server error")] * 4)
    content, attempts, status, error = M.call_with_retry(f(), "p", "m", 4, 1.5, delays.append)
    assert (content, attempts, status) == (None, 4, M.API_ERROR)
    assert "after 4 attempts" in error and "Persistent server error" in error
    assert delays == [1.5, 3.0, 6.0]


@pytest.mark.parametrize("reply,msg", [(NoText(), "without a text field"), (Reply("   "), "empty text")])
def test_bad_reply_not_retried(reply, msg):
    calls = []

    def factory():
        def call(p, m):
            calls.append(1)
            return reply
        return call
    _, attempts, status, error = M.call_with_retry(factory(), "p", "m", 3, 0.0, lambda d: None)
    assert (attempts, status, len(calls)) == (1, M.BAD_REPLY, 1) and msg in error


def test_infer_batch_in_spark_and_config_error(spark):
    df = spark.createDataFrame([(i, f"p{i}", "m", 3) for i in range(6)],
                               "req_id long, prompt string, model string, max_retries int")
    out = M.infer_batch(df, _script([RuntimeError("x"), Reply(" ok ")] * 6), partitions=1,
                        initial_delay=0.0).orderBy("req_id").collect()
    assert all((r.content, r.attempts, r.status) == ("ok", 2, M.OK) for r in out)

    def broken():
        raise M.ProviderConfigError("API key is not set")
    out = M.infer_batch(df, broken, initial_delay=0.0).collect()
    assert {(r.status, r.error) for r in out} == {(M.CONFIG_ERROR, "API key is not set")}


def test_degrade_and_check_reply(spark):
    df = spark.createDataFrame([("ok", "fine", None), ("api_error", None, "rate limited"),
                                ("config_error", None, "missing key")], "status string, content string, error string")
    got = [r.s for r in df.select(M.degrade_errors().alias("s")).collect()]
    assert got == ["fine", "Model summarization failed: rate limited", "Model configuration error: missing key"]
    r = spark.createDataFrame([(None,), ("  ",), ("x",)], "c string")
    assert [x.s for x in r.select(M.check_reply("c").alias("s")).collect()] == [
        M.BAD_REPLY, M.BAD_REPLY, M.OK]


def test_prompt_rules(spark):
    df = spark.createDataFrame([(f, 2, DESCRIPTION_LEVELS[1], SUMMARY_LEVELS[3], "  This is a long text.  ")
                                for f in ("txt", "md", "json", "yaml")],
                               "output_format string, sentences int, desc_instruction string, "
                               "sum_instruction string, text string")
    p = {r.output_format: r.p for r in df.select("output_format", M.build_prompt("text").alias("p")).collect()}
    lines = {f: v.split("\n") for f, v in p.items()}
    for f, part in (("txt", "summary"), ("md", "summary section"), ("json", "full_summary"), ("yaml", "summary")):
        assert f"Length of {part}: 2 sentences or fewer" in lines[f]
        assert "Description: " + DESCRIPTION_LEVELS[1] in lines[f] and "Summary: " + SUMMARY_LEVELS[3] + "." in lines[f]
        assert lines[f][-2:] == ["Document:", "This is a long text."]
    form = {f: next(x for x in v if x.startswith("Form: ")) for f, v in lines.items()}
    assert form["txt"] == "Form: txt - plain text, no Markdown and no JSON" and form["md"] == "Form: md - Markdown"
    assert "unknown" in form["yaml"] and "yaml" not in form["yaml"] and "txt" not in form["yaml"]
    shape = next(x for x in lines["json"] if x.startswith("Shape: "))
    assert json.loads(shape[len("Shape: "):]) == dict.fromkeys(
        ["document_title", "short_description", "short_summary", "full_summary"], "")
    assert "Length of short_description: exactly 3 sentences" in lines["json"]


def test_output_rules(spark, tmp_path):
    df = spark.createDataFrame([
        ('```json\n{"a": 1, "é": "ü"}\n```', "json"), ('  {"b": [1, 2]}  ', "json"),
        ("```json\n{bad\n```", "json"), ("  plain text  ", "txt")], "c string, f string")
    got = [r.n for r in df.select(normalize_output("c", "f").alias("n")).collect()]
    assert got[0] == json.dumps({"a": 1, "é": "ü"}, indent=2, ensure_ascii=False) + "\n"
    assert got[1] == json.dumps({"b": [1, 2]}, indent=2) + "\n"
    assert got[2] == "{bad" and got[3] == "plain text"
    t = spark.createDataFrame([("out/sum", "md"), ("out/sum.md", "md"), ("out/sum.txt", "md"),
                               (None, "txt"), ("out/sum.JSON", "json")], "t string, f string")
    r = t.select(resolve_target("t", "f").alias("x")).collect()
    assert [x.x.path for x in r] == ["out/sum.md", "out/sum.md", None, None, None]
    assert r[2].x.error == "Output file extension '.txt' does not match requested format 'md'"
    assert r[4].x.error is not None  # exact, case-sensitive compare
    files = spark.createDataFrame([(str(tmp_path / "a" / "b" / "s.md"), "hello")],
                                  "target_path string, saved_content string")
    assert export_files(files) == 1
    assert (tmp_path / "a" / "b" / "s.md").read_text() == "hello"


def test_summarize_routes(spark):
    docs = spark.createDataFrame([(1, "First one. Second two. Third."), (2, "   ")], "doc_id long, text string")
    req = spark.createDataFrame([
        (1, 1, False, None, None, None, None, None, None),
        (2, 1, True, 1, "low", "json", "o/x", None, None),
        (3, 1, True, None, None, "md", "o/x.txt", None, None),
        (4, 3, False, None, None, None, None, None, None),
        (5, 2, True, None, None, None, None, None, None)],
        "req_id long, doc_id long, use_model boolean, sentences int, effort string, "
        "output_format string, target string, desc_level int, sum_level int")
    out = {r.req_id: r for r in summarize(req, docs, M.LeadProvider(fail_mod=0), initial_delay=0.0).collect()}
    assert out[1].route == "local" and out[1].content == "First one. Second two."
    assert out[2].route == "model" and out[2].status == M.OK
    assert out[2].saved_content == '{\n  "full_summary": "First one."\n}\n' and out[2].target_path == "o/x.json"
    assert out[3].status == M.CONFIG_ERROR
    assert out[3].content.startswith("Model configuration error: Output file extension '.txt'")
    assert out[4].route == "rejected" and out[4].error == "File not found: 3"
    assert out[5].status == M.BAD_REPLY and "empty text" in out[5].error
    assert out[5].content.startswith("Model summarization failed")


def test_requested_documents_prefilter(spark):
    from docweave.plans.summarize import requested_documents
    docs = spark.range(100).select(F.col("id").alias("_dk"), F.lit("t").alias("_text"))
    few = spark.createDataFrame([(3,), (5,), (5,), (None,)], "doc_id long")
    kept = requested_documents(few, docs, max_ids=1000)
    assert sorted(r._dk for r in kept.collect()) == [3, 5]
    assert "LeftSemi" in kept._jdf.queryExecution().executedPlan().toString()
    many = spark.range(80).select(F.col("id").alias("doc_id"))
    assert requested_documents(many, docs, max_ids=1000).count() == 100  # most requested: no filter
    assert requested_documents(few, docs, max_ids=1).count() == 100  # over the bound


def test_summarize_attaches_name_and_title(spark):
    docs = spark.createDataFrame([(1, "my_report-2024.txt", "Alpha. Beta. Gamma.")],
                                 "doc_id long, name string, text string")
    req = spark.createDataFrame([(1, 1, False, None, None, None, None, None, None)],
                                "req_id long, doc_id long, use_model boolean, sentences int, effort string, "
                                "output_format string, target string, desc_level int, sum_level int")
    r = summarize(req, docs, M.LeadProvider(fail_mod=0), initial_delay=0.0, name_col="name").first()
    assert (r.name, r.title, r.content) == ("my_report-2024.txt", "my report 2024", "Alpha. Beta.")


def test_materialized_replies_are_not_recomputed(spark):
    """Provider calls are side effects: after materialize=True, further
    actions read the checkpoint instead of calling the provider again."""
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def call(prompt, model):
            calls.add(1)
            return "ok"
        return call

    docs = spark.createDataFrame([(i, f"Text {i}. More.") for i in range(20)], "doc_id long, text string")
    req = spark.createDataFrame([(i, i, True, None, None, None, None, None, None) for i in range(20)],
                                "req_id long, doc_id long, use_model boolean, sentences int, effort string, "
                                "output_format string, target string, desc_level int, sum_level int")
    out = summarize(req, docs, factory, initial_delay=0.0, materialize=True)
    assert out.where("status = 'ok'").count() == 20
    assert out.count() == 20
    assert calls.value == 20


def test_bucketed_documents_are_not_shuffled(spark, tmp_path):
    """With the corpus bucketed by doc_id only the request side moves."""
    from docweave.plans.summarize import prepare_requests
    from docweave.sources.layout import save_bucketed
    docs = spark.createDataFrame([(i, f"Doc {i}. Text.") for i in range(200)], "doc_id long, text string")
    bucketed = save_bucketed(docs, "docs_bucketed_test", str(tmp_path / "docs"), buckets=8)
    req = spark.createDataFrame([(i, i % 150, False, None, None, None, None, None, None) for i in range(300)],
                                "req_id long, doc_id long, use_model boolean, sentences int, effort string, "
                                "output_format string, target string, desc_level int, sum_level int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prep = prepare_requests(req, bucketed, prefilter_max_ids=None)
        plan = prep._jdf.queryExecution().executedPlan().toString()
        assert prep.where("error_class IS NULL").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS docs_bucketed_test")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the request side only


def test_identical_prompts_call_the_provider_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def call(prompt, model):
            calls.add(1)
            return "summary"
        return call

    docs = spark.createDataFrame([(1, "Hot doc. Everyone asks."), (2, "Cold doc.")], "doc_id long, text string")
    rows = [(i, 1, True, None, None, None, None, None, None) for i in range(30)]  # hot document
    rows += [(100, 2, True, None, None, None, None, None, None),
             (101, 1, True, 3, None, None, None, None, None)]  # other options: another prompt
    req = spark.createDataFrame(rows, "req_id long, doc_id long, use_model boolean, sentences int, "
                                      "effort string, output_format string, target string, "
                                      "desc_level int, sum_level int")
    out = summarize(req, docs, factory, initial_delay=0.0, materialize=True)
    got = out.collect()
    assert len(got) == 32 and all(r.status == "ok" and r.content == "summary" for r in got)
    assert calls.value == 3
