"""One bad row never fails a job, and nothing is dropped or cut short."""

from pyspark.sql import functions as F

from docweave.functions.html import html_visible_text
from docweave.functions.jsontext import json_pretty
from docweave.functions.text import all_chunk_rows, local_summary, summaries_from_chunk_rows
from docweave.operators.inference import LeadProvider, build_prompt, infer_batch
from docweave.plans.summarize import summarize
from docweave.sources.files import load_corpus_text, read_corpus


def test_lone_surrogate_becomes_replacement(spark):
    df = spark.createDataFrame([(1, '{"t": "x\\ud83d"}'), (2, '{"t": "ok"}')], "id int, j string")
    got = {r.id: r.p for r in df.select("id", json_pretty("j").alias("p")).collect()}
    assert "\ufffd" in got[1]["text"] and got[1]["error"] is None
    assert '"ok"' in got[2]["text"]


def test_provider_reply_with_surrogate(spark):
    df = spark.createDataFrame([("a", "p", "m", 1)], "req_id string, prompt string, model string, max_retries int")
    row = infer_batch(df, lambda: (lambda prompt, model: "hi \ud83d")).first()
    assert row.status == "ok" and row.content == "hi \ufffd"


def test_long_field_bad_bytes_and_wrong_extractor_result(spark):
    rows = [("a.csv", b"x," + b"y" * 200_000 + b"\n1,2"), ("b.csv", b"caf\xe9,1"), ("c.dat", b"1"), ("d.txt", b"fine")]
    files = spark.createDataFrame(rows, "path string, content binary").withColumns(
        {"error_class": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    got = {r.path: r for r in load_corpus_text(files, extractors={".dat": lambda b: {"no": "text"}}).collect()}
    assert len(got["a.csv"].text) > 200_000 and got["a.csv"].error_class is None
    assert got["b.csv"].text == "caf\ufffd, 1"
    assert got["c.dat"].error_class == "extractor_error" and "dict" in got["c.dat"].error
    assert got["d.txt"].text == "fine"


def test_html_nodes_are_read_leftmost_first(spark):
    pages = ["<p>a</p><!-- old <script> tag --><p>b</p><p>c</p>",
             "<p>a</p><template><b>x</b><template>y</template>z</template><p>b</p>",
             '<a title="<style>">a</a><p>b</p>', "<p>a</p><style>x<p>y</p>", "<p>a</p><template><p>b</p>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, h string")
    got = [r.t for r in df.orderBy("id").select(html_visible_text("h").alias("t")).collect()]
    assert got == ["a\nb\nc", "a\nb", "a\nb", "a", "a"]


def test_row_form_keeps_empty_and_null_documents(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, ""), (3, None)], "doc_id int, text string")
    rows = {r.doc_id: r.summary for r in summaries_from_chunk_rows(all_chunk_rows(df)).collect()}
    plain = {r.doc_id: r.s for r in df.select("doc_id", F.coalesce(local_summary("text"), F.lit("")).alias("s")).collect()}
    assert rows == plain and set(rows) == {1, 2, 3}


REQUEST = ("req_id string, doc_id string, use_model boolean, sentences int, effort string, target string, "
           "output_format string, desc_level int, sum_level int")


def _requests(spark):
    return spark.createDataFrame([(f"r{i}{m}", f"d{i}", bool(m), None, None, None, None, None, None)
                                  for i in range(3) for m in (0, 1)], REQUEST)


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-build"))


def test_documents_that_failed_to_load_are_not_summarised(spark):
    docs = spark.createDataFrame([("d0", "Good text. More.", None, None), ("d1", None, "bad_json", "not JSON"),
                                  ("d2", None, None, None)], "doc_id string, text string, error_class string, error string")
    got = {r.req_id: r for r in summarize(_requests(spark), docs, LeadProvider(fail_mod=0)).collect()}
    for m in "01":
        assert got[f"r0{m}"].status == "ok"
        assert (got[f"r1{m}"].route, got[f"r1{m}"].status, got[f"r1{m}"].error_class, got[f"r1{m}"].attempts) == ("failed", "failed", "bad_json", 0)
        assert got[f"r2{m}"].error_class == "no_text" and got[f"r2{m}"].content is None


def test_building_the_plan_starts_no_job(spark):
    docs = spark.createDataFrame([("d0", "Good text.")], "doc_id string, text string").repartition(3)
    spark.sparkContext.setJobGroup("plan-build", "")
    try:
        before = _jobs(spark)
        summarize(_requests(spark).repartition(3), docs)
        assert _jobs(spark) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_text_no_prompt(spark):
    df = spark.createDataFrame([(None, "txt", 5, "d", "s")], "t string, output_format string, sentences int, desc_instruction string, sum_instruction string")
    assert df.select(build_prompt("t").alias("p")).first().p is None


def test_paths_of_other_schemes_are_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = {r.path: r.error_class for r in read_corpus(spark, str(tmp_path), wanted=["s3a://bucket/x.txt"]).collect()}
    assert got["s3a://bucket/x.txt"] == "not_found"
