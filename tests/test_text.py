"""T1-T8 against a plain Python statement of the same rules (brute force)."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T

PLACEHOLDER = "No readable content found."


# ---- expectations from a walk over the words of a text ------------------------
def one_spaced(t):
    return " ".join(t.split())


def sentences(t):
    """Words gather until one ends in a full stop or the like."""
    done, now = [], []
    for word in t.split():
        now.append(word)
        if word[-1] in ".!?":
            done.append(" ".join(now))
            now = []
    return done + ([" ".join(now)] if now else [])


def lead(t, n):
    return " ".join(sentences(t)[:n]) or PLACEHOLDER


def summary(t, size=2000):
    parts, rest = [], t
    while rest:
        parts.append(lead(rest[:size], 2))
        rest = rest[size:]
    return "\n\n".join(parts)


EMOJI = "\U0001F600"
EDGE = [
    "", "   ", "\t\n", "One. Two! Three? Four.", "no final punctuation here",
    "Pi is 3.14 today. e.g. x is fine. Done", "What?! Really?! Yes.",
    "a b c　d.\x1ce\x1df. g\x0bh.", "line one.\r\nline two.\rline three.",
    "x" * 2000, "y" * 2001, ("ab. " * 500)[:1999] + EMOJI + "z. tail.",
    "A." * 5000, " lead and trail spaces.  Next.  ", "\x85Start. end\x85",
    "Só ünïcödé. Ελληνικά! 中文。 ok? yes.",
]


@pytest.fixture(scope="module")
def edge_df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)] + [(len(EDGE), None)],
                                 "id int, text string")


def test_normalize_whitespace(edge_df):
    got = {r.id: r.n for r in edge_df.select("id", T.normalize_whitespace("text").alias("n")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == one_spaced(t), (i, t)


def test_split_sentences(edge_df):
    got = {r.id: r.s for r in edge_df.select("id", T.split_sentences("text").alias("s")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == sentences(t), (i, t)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_lead_summary(edge_df, n):
    got = {r.id: r.s for r in edge_df.select("id", T.lead_summary("text", n).alias("s")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == lead(t, n), (i, t)
    assert got[len(EDGE)] == PLACEHOLDER  # null text


def test_lead_summary_rejects_zero():
    with pytest.raises(ValueError):
        T.lead_summary("text", 0)


def test_chunks_count_code_points(edge_df):
    rows = edge_df.select("id", T.chunk_text("text").alias("c")).collect()
    for r in rows:
        if r.id < len(EDGE):
            t = EDGE[r.id]
            assert r.c == [t[i:i + 2000] for i in range(0, len(t), 2000)], r.id


def test_chunk_size_parameter(spark):
    df = spark.createDataFrame([("A." * 5000,)], "text string")
    chunks = df.select(T.chunk_text("text", 1000).alias("c")).first().c
    assert len(chunks) == 10 and all(len(c) == 1000 for c in chunks)


def test_local_summary_in_row_and_row_form_agree(edge_df):
    got = {r.id: r.s for r in edge_df.select("id", T.local_summary("text").alias("s")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == summary(t), (i, t)
    assert got[0] == ""  # empty text: no chunks
    assert got[1] == PLACEHOLDER  # whitespace-only chunk contributes the placeholder
    rows = T.summaries_from_chunk_rows(T.chunk_rows(edge_df.withColumnRenamed("id", "doc_id"))).collect()
    for r in rows:
        assert r.summary == summary(EDGE[r.doc_id])


def test_local_summary_matches_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", T.local_summary("text").alias("s")).collect():
        assert r.s == summary(r.text)


def test_shorten_title_and_level_label(spark):
    df = spark.createDataFrame([("hello_world-file", 1), ("a-b_c", 2), ("x", 3), ("y", 0)],
                               "stem string, lv int")
    rows = df.select(T.shorten_title("stem").alias("t"), T.level_label("lv").alias("l")).collect()
    assert [r.t for r in rows] == ["hello world file", "a b c", "x", "y"]
    assert [r.l for r in rows] == ["brief", "detailed", "full", "full"]


def test_strip_ws_matches_python(spark):
    vals = [" a ", "　\xa0x\x1c", "\x85", "é ", "\tq\n"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r.s for r in df.select(T.strip_ws("v").alias("s")).collect()] == [v.strip() for v in vals]


def test_plan_stays_in_codegen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.select("doc_id", T.local_summary("text").alias("s"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in docs.select(
        "doc_id", T.local_summary("text"))._jdf.queryExecution().executedPlan().toString() \
        or "doc_id" in plan
    assert "Exchange" not in plan  # in-row form: no shuffle
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_row_form_spread_gives_same_summaries(spark):
    long_doc = " ".join(f"Sentence number {i} is here." for i in range(3000))  # ~90k chars, 45 chunks
    df = spark.createDataFrame([(1, long_doc), (2, "Short one. Two.")], "doc_id long, text string")
    spread = {r.doc_id: r.summary for r in
              T.summaries_from_chunk_rows(T.chunk_rows(df), spread=8).collect()}
    assert spread == {1: summary(long_doc), 2: summary("Short one. Two.")}
