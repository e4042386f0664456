"""Documents that fit no cell or no row: texts in blocks, XML and notebooks as
rows, parts with running places; the json reply as columns."""

import hashlib
import json
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions.text import local_summary
from docweave.operators import assemble as A
from docweave.operators import structured as S
from docweave.operators.inference import degrade_errors
from docweave.operators.output import json_reply
from docweave.sources import bigtext
from docweave.sources.files import decode_text, load_corpus_text, read_corpus
from docweave.streaming.incremental import summarize_corpus, summarize_files


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    """Files whose cuts fall into characters, line ends and broken bytes."""
    rng = np.random.default_rng(5)
    folder = tmp_path_factory.mktemp("texts")
    units = [b"word ", b"Done. ", b"\r\n", b"\r", b"\n", b"\xc3\xa9", b"\xe6\x97\xa5", b"\xf0\x9f\x99\x82", b"\xff", b"\xe6\x97", b"? ", b"!\n", b"\x00"]
    for i in range(12):
        (folder / f"t{i}.txt").write_bytes(b"".join(units[k] for k in rng.integers(0, len(units), int(rng.integers(1, 3000)))))
    (folder / "none.txt").touch()
    (folder / "high.md").write_bytes("日本語".encode() * 900)  # no place to cut at
    (folder / "ends.txt").write_bytes(b"a\r\n" * 500)
    return folder


def test_texts_in_blocks_are_the_whole_texts(spark, texts):
    files = read_corpus(spark, str(texts))
    want = {r.path: (r.t, r.s) for r in files.select("path", decode_text("content").alias("t"), local_summary(decode_text("content"), 50, 2).alias("s")).collect()}
    for block_bytes in (7, 64, 1000, 1 << 20):
        got = {r.path: r for r in bigtext.big_text_summaries(files.select("path", "length"), size=50, block_bytes=block_bytes).collect()}
        assert {p: (r.n_chars, r.summary) for p, r in got.items()} == {p: (len(t), s) for p, (t, s) in want.items()}
    blocks = bigtext.text_blocks(files.select("path", "length"), 64)
    assert blocks.where("path like '%ends.txt'").count() == 24
    pieces = bigtext.text_pieces(blocks, 50, 64)
    for p, rows in {p: [r for r in pieces.where(F.col("path") == p).collect()] for p in list(want)[:4]}.items():
        assert "".join(r.piece for r in sorted(rows, key=lambda r: (r.chunk_no, r.inside))) == want[p][0]


def test_corpus_with_files_of_any_size(spark, texts, tmp_path):
    (tmp_path / "small.txt").write_text("One. Two. Three.")
    long = "A sentence of words. " * 400
    (tmp_path / "big_text-1.md").write_text(long)
    (tmp_path / "big.csv").write_text("".join(f"r{i},v{i}\n" for i in range(2000)))
    (tmp_path / "big.json").write_text('{"a": "' + "x" * 5000 + '"}')
    (tmp_path / "big.log7").write_text("y" * 5000)
    (tmp_path / "mine.txt").write_text("z" * 5000)
    (tmp_path / "none.txt").touch()
    got = {r.name: r for r in summarize_corpus(read_corpus(spark, str(tmp_path), max_bytes=2000), block_bytes=256).collect()}
    whole = {r.name: r for r in summarize_files(read_corpus(spark, str(tmp_path))).collect()}
    for name in ("small.txt", "big_text-1.md", "big.csv", "mine.txt", "none.txt"):
        assert got[name] == whole[name], name
    assert got["big_text-1.md"].title == "big text 1" and got["big_text-1.md"].n_chars == len(long)
    assert got["big.json"].error_class == "too_large" and got["big.json"].summary is None and "5009 bytes" in got["big.json"].error
    assert len(got) == 7 and got["big.log7"].error_class == "too_large"
    mine = {r.name: r for r in summarize_corpus(read_corpus(spark, str(tmp_path), max_bytes=2000), {".txt": bytes.decode}).collect()}
    assert mine["mine.txt"].error_class == "too_large"  # a user's extractor takes whole files


XML = ['<a x="1" y="&lt;"> lead <b>t</b> tail <c/><!-- no --> more</a>', "<n:a xmlns:n='u'><n:b n:k='v'/></n:a>", "<a><b></a>", "", "plain", None,
       "<?xml version='1.0' encoding='latin-1'?><é>ü<x/></é>", "<a>one<!-- c -->two<b>\n </b></a>", "<!DOCTYPE a [<!ENTITY e 'v'>]><a>&e;</a>", "<a>&nope;</a>"]


def walked(raw):
    """Element rows by a recursive walk over the whole tree."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return [(0, "raw", None, None, raw)]

    def walk(el, level):
        yield level, "open", el.tag, dict(el.attrib), None
        if el.text and el.text.strip():
            yield level, "text", el.tag, None, el.text.strip()
        for child in el:
            yield from walk(child, level + 1)
        yield level, "close", el.tag, None, None

    return list(walk(root, 0))


def test_xml_rows_are_the_trees(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(XML)), "doc_id int, text string").withColumn("seq", F.lit("clash"))
    for fed, batch in ((1 << 16, 2_048), (1, 2)):
        monkeypatch.setattr(S, "FED", fed)
        monkeypatch.setattr(S, "BATCH", batch)
        rows = S.xml_elements(df).orderBy("doc_id", "seq").collect()
        assert [(r.doc_id, r.level, r.kind, r.tag, r.attrs, r.text) for r in rows] == [
            (i, *w) for i, raw in enumerate(XML) if raw is not None for w in walked(raw)]
        assert [r.seq for r in rows if r.doc_id == 0] == list(range(8))
    outlines = [r.o for r in df.orderBy("doc_id").select(S.xml_outline("text").alias("o")).collect()]
    assert outlines[2] == XML[2] and outlines[5] is None and outlines[1] == '<{u}a>\n  <{u}b {u}k="v">\n  </{u}b>\n</{u}a>'


def test_walking_a_large_xml_document_keeps_little():
    piece = "<row k='v'><cell>some text</cell><cell/></row>"
    peaks = []
    for n in (2_000, 40_000):
        raw = "<t>" + piece * n + "</t>"
        tracemalloc.start()
        assert S.xml_error(raw) is None
        assert sum(1 for _ in S.xml_steps(raw)) == 2 + 7 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (1 << 20)


def test_a_notebook_with_a_cell_of_30_mb(spark, tmp_path):
    big = "x = '" + "abcd" * 7_500_000 + "'"
    (tmp_path / "big.ipynb").write_text(json.dumps({"cells": [
        {"cell_type": "code", "source": [big, "\n"]}, {"cell_type": "markdown", "source": " "}, {"cell_type": "markdown", "source": "# end"}]}))
    (tmp_path / "bad.ipynb").write_text("[" + " " * (S.LARGE_NOTEBOOK + 1) + "]")
    texts = load_corpus_text(read_corpus(spark, str(tmp_path)))
    rows = {r.name: r for r in texts.select("name", F.sha2(F.col("text").cast("binary"), 256).alias("h"), "error_class").collect()}
    want = hashlib.sha256(("# code cell\n\n" + big + "\n\n\n# end").encode()).hexdigest()
    assert (rows["big.ipynb"].h, rows["big.ipynb"].error_class) == (want, None)
    assert (rows["bad.ipynb"].h, rows["bad.ipynb"].error_class) == (None, "bad_json")


NOTEBOOKS = [{"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "raw", "source": "\t"}, {"cell_type": "markdown"},
                        {"cell_type": "markdown", "source": "c"}, {"cell_type": "code", "source": []}]}, {}, {"cells": []}, {"cells": [{"source": "no type"}]}]


def test_small_and_large_notebooks_follow_one_rule(spark):
    raw = [json.dumps(n) for n in NOTEBOOKS]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*raw, None])], "doc_id int, text string")
    jvm = [r.t for r in df.orderBy("doc_id").select(S.notebook_text("text").alias("t")).collect()]
    assert jvm[:-1] == [S.notebook_text_one(r)[0] for r in raw] and S.notebook_text_one(None) == (None, None)
    cells = sorted(tuple(r) for r in S.notebook_cells(df.unionByName(spark.createDataFrame([(9, "[1]"), (10, "{")], df.schema))).where("doc_id <> 3").collect())
    assert cells == [(0, 0, "code", "a\nb"), (0, 3, "markdown", "c")]


def test_part_rows_are_the_assembled_texts(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(None if d == 3 else d, int(n), ["", " \t", "é" * int(rng.integers(1, 9)), "two words"][int(rng.integers(0, 4))])
            for d in range(4) for n in rng.permutation(200)]
    rows += [(1, 7, "twice"), (1, None, "unnumbered"), (5, 0, None), (6, 0, " ")]
    df = spark.createDataFrame(rows, "doc_id long, part_no int, text string").withColumn("_n", F.lit("clash"))
    out = A.part_rows(df, block_parts=16)
    A.write_part_rows(out, str(tmp_path / "parts"), files=6)
    back = spark.read.parquet(str(tmp_path / "parts"))
    for d in (0, 1, 2, None):
        got = sorted((r.start, r.text) for r in back.where(F.col("doc_id").eqNullSafe(F.lit(d))).collect())
        mine = sorted((r for r in rows if r[0] == d and r[2] and r[2].strip()), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [t for _, t in got] == [r[2] for r in mine]
        text = A.PART_SEP.join(r[2] for r in mine)
        assert all(text[s:s + len(t)] == t for s, t in got)
    assert back.where("doc_id >= 5").count() == 0
    names = sorted(n for n in os.listdir(tmp_path / "parts") if n.endswith(".parquet"))
    assert len(names) > 3  # written by many tasks, in order
    ends = [spark.read.parquet(str(tmp_path / "parts" / n)).where("doc_id = 0").agg(F.min("start"), F.max("start")).first() for n in names]
    ends = [tuple(e) for e in ends if e[0] is not None]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_json_replies(spark):
    whole = {"document_title": "", "short_description": "d", "short_summary": "é 😀", "full_summary": "f"}
    cases = [json.dumps(whole), "```json\n" + json.dumps(whole) + "\n```", " ```\n" + json.dumps(whole) + "```\n", json.dumps(whole | {"more": [1]}),
             json.dumps(whole | {"full_summary": {"a": 1}}), json.dumps({"document_title": "t"}), json.dumps([whole]), "{}", "{bad", "text", "", "  ", None,
             json.dumps(whole | {"short_summary": None})]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i")
    got = [r.r for r in df.select(json_reply("c").alias("r")).collect()]
    assert [r.status for r in got] == ["ok"] * 5 + ["bad_reply"] * 9
    for r in got[:4]:
        assert {k: r[k] for k in whole} == whole and r.error is None
    assert json.loads(got[4].full_summary) == {"a": 1}
    assert got[5].document_title == "t" and got[5].error == "the reply lacks short_description, short_summary, full_summary"
    assert {got[i].error for i in (6, 8, 9)} == {"the reply is not a JSON object"} and got[7].error.count(",") == 3
    assert {got[i].error for i in (10, 11, 12)} == {"the reply is empty"} and got[13].error == "the reply lacks short_summary"
    told = df.select(json_reply("c").alias("r")).select(degrade_errors("r.status", "r.full_summary", "r.error").alias("s")).collect()
    assert told[0].s == "f" and told[8].s == "Model summarization failed: the reply is not a JSON object"


def test_a_text_in_several_files_is_one_text(spark, tmp_path):
    lines = [f"Sentence {i} of the text. Ünd more {'x' * (i % 37)}!\n" for i in range(200)]
    for k in range(5):
        (tmp_path / f"part-{k}.txt").write_text("".join(lines[40 * k:40 * k + 40]))
    (tmp_path / "whole.txt").write_text("".join(lines))
    files = read_corpus(spark, str(tmp_path)).select("path", "length")
    parts = files.where("path LIKE '%part-%'").withColumns({"text": F.lit("t"), "part": F.substring_index("path", "/", -1)})
    got = bigtext.big_text_summaries(parts, size=50, block_bytes=300).collect()
    want = bigtext.big_text_summaries(files.where("path LIKE '%whole%'"), size=50, block_bytes=1 << 20).collect()
    assert [(r.path, r.n_chars, r.summary) for r in got] == [("t", want[0].n_chars, want[0].summary)]


def test_python_stages_take_bounded_batches(spark, tmp_path):
    from docweave.operators.inference import infer_batch
    from docweave.sources.files import load_corpus_text
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.createDataFrame([("a.txt", "One.")], "path string, content string")
    for plan in (lambda: load_corpus_text(rows), lambda: infer_batch(rows.selectExpr("path AS req_id", "content AS prompt", "'m' AS model", "1 AS max_retries"), lambda: None)):
        spark.conf.set(setting, "10000")
        try:
            plan()
            assert int(spark.conf.get(setting)) == 1_000  # a worker holds a batch of whole texts several times over
        finally:
            spark.conf.unset(setting)
