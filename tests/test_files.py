"""S1-S3, U1 and G1 on files made in a temporary folder (good, broken,
empty, unknown and missing ones)."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.operators.report import loader_report
from docweave.sources.files import decode_text, load_corpus_text, read_corpus
from docweave.sources.formats import FORMATS, route_by_extension, supported_list


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "letter.txt").write_text("Dear Ada,\nthe kiln is fixed.", encoding="utf-8")
    (d / "crlf.md").write_bytes(b"line one\r\nline two\rthree \xff\xfe end")
    (d / "scan.raw7").write_text("grey pixels")
    (d / "data.json").write_text('{"kiln":"K2","temps":[900,1250]}')
    (d / "bad.json").write_text('{"kiln": ')
    (d / "data.xml").write_text("<kiln><zone no='3'>hot</zone></kiln>")
    (d / "broken.xml").write_text("<kiln><zone></kiln>")
    (d / "data.csv").write_text("\n".join(f"day {i},{i * 7}" for i in range(40)))
    (d / "nb.ipynb").write_text(json.dumps({"cells": [
        {"cell_type": "code", "source": ["ramp = 5\n", "ramp * 60"]},
        {"cell_type": "raw", "source": ["\n"]},
        {"cell_type": "markdown", "source": "Ramp in degrees"}]}))
    (d / "page.html").write_text("<p>a &amp; b</p><script>x</script>")
    (d / "deck.pptx").write_bytes(b"")
    (d / "Upper.TXT").write_text("case folded suffix")
    return d


def _texts(spark, d, **kw):
    files = read_corpus(spark, str(d), wanted=[str(d / "missing.txt")], include_empty=True)
    out = load_corpus_text(files, **kw).collect()
    return {r.name: r for r in out}


def test_loaders(spark, corpus):
    t = _texts(spark, corpus)
    assert t["letter.txt"].text == "Dear Ada,\nthe kiln is fixed."
    assert t["crlf.md"].text == b"line one\r\nline two\rthree \xff\xfe end".decode(
        "utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    assert t["scan.raw7"].error_class == "unsupported_type"
    assert t["scan.raw7"].error == (
        "Unsupported file type: .raw7. Supported: " + supported_list())
    assert t["missing.txt"].error_class == "not_found"
    assert t["data.json"].text == '{\n  "kiln": "K2",\n  "temps": [\n    900,\n    1250\n  ]\n}'
    assert t["bad.json"].error_class == "bad_json" and t["bad.json"].text is None
    assert t["data.xml"].text == '<kiln>\n  <zone no="3">\n    hot\n  </zone>\n</kiln>'
    assert t["broken.xml"].text == "<kiln><zone></kiln>"
    assert t["data.csv"].text == "\n".join(f"day {i}, {i * 7}" for i in range(20))
    nb = t["nb.ipynb"].text
    assert nb == "# code cell\n\nramp = 5\nramp * 60\n\nRamp in degrees"
    assert t["page.html"].text == "a & b"
    assert t["deck.pptx"].error_class == "missing_dependency"
    assert t["deck.pptx"].error.startswith("No built-in extractor for pptx files: pass your own as extractors=")
    assert t["Upper.TXT"].text == "case folded suffix"


def test_custom_extractor_and_errors(spark, corpus):
    def shout(b: bytes) -> str:
        return b.decode().upper()

    def boom(b: bytes) -> str:
        raise RuntimeError("cannot read")

    t = _texts(spark, corpus, extractors={".txt": shout, ".pptx": boom, ".raw7": shout})
    assert t["letter.txt"].text == "DEAR ADA,\nTHE KILN IS FIXED."
    assert t["scan.raw7"].text == "GREY PIXELS" and t["scan.raw7"].error_class is None
    assert t["deck.pptx"].error_class == "extractor_error" and "cannot read" in t["deck.pptx"].error
    assert t["missing.txt"].error_class == "not_found"


def test_loader_report(spark, corpus):
    files = read_corpus(spark, str(corpus), include_empty=True)
    rep = {r.ext: r for r in loader_report(load_corpus_text(files)).collect()}
    assert rep[".txt"].n_files == 2 and rep[".txt"].n_ok == 2
    assert rep[".json"].n_ok == 1 and rep[".json"].error_class == "bad_json"
    assert rep[".pptx"].error_class == "missing_dependency"
    assert rep[".csv"].preview.startswith("day 0, 0")
    assert all(r.all_ok is False for r in rep.values())


def test_route_suffix_rules(spark):
    names = ["a/.env", "b/x.tar.gz", "c/foo.", "d/..x", "e/a..b", "f/README", "g/X.Py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: (r.suffix, r.stem, r.kind) for r in route_by_extension(df).collect()}
    from pathlib import PurePosixPath as P
    for n in names:
        assert got[n][0] == P(n).suffix and got[n][1] == P(n).stem, n
    assert got["g/X.Py"][2] == "text"
    assert len(FORMATS) == 17


def test_decode_text_replacement(spark):
    raw = b"ok \xff\xfe end\r\nx\ry \xe2\x82"
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    got = df.select(decode_text("b").alias("t")).first().t
    assert got == raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def test_bad_notebook_is_quarantined(spark, tmp_path):
    (tmp_path / "a.ipynb").write_text("[1, 2]")
    (tmp_path / "b.ipynb").write_text("{not json")
    (tmp_path / "c.ipynb").write_text('{"cells": [{"cell_type": "code", "source": "x = 1"}]}')
    rows = {r.name: r for r in load_corpus_text(read_corpus(spark, str(tmp_path))).collect()}
    for n in ("a.ipynb", "b.ipynb"):
        assert rows[n].error_class == "bad_json" and rows[n].text is None
    assert rows["c.ipynb"].text == "# code cell\n\nx = 1" and rows["c.ipynb"].error_class is None


def test_user_extension_joins_supported_list(spark):
    df = spark.createDataFrame([("a/x.rst",), ("b/y.zzz",)], "path string")
    rows = {r.path: r for r in route_by_extension(df, extra={".rst": lambda b: b.decode()}).collect()}
    assert rows["a/x.rst"].kind == "custom" and rows["a/x.rst"].error_class is None
    assert ".rst" in rows["b/y.zzz"].error.split("Supported: ")[1].split(", ")


def test_loader_check_one_file_per_extension(spark, tmp_path):
    """Every registered extension gets one placeholder: text-like formats a
    two-line sample (the notebook a one-cell notebook), the others an empty
    file; the report says per extension what loaded."""
    text_like = {".txt", ".md", ".py", ".js", ".java", ".cpp", ".html", ".csv"}
    for ext, _, _ in FORMATS:
        path = tmp_path / f"w{ext}"
        if ext == ".ipynb":
            path.write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Notebook"]}]}))
        elif ext in text_like:
            path.write_text(f"Sample content for w{ext}\nLine two.")
        else:
            path.write_bytes(b"")
    files = read_corpus(spark, str(tmp_path), include_empty=True)
    rep = {r.ext: r for r in loader_report(load_corpus_text(files)).collect()}
    assert set(rep) == {ext for ext, _, _ in FORMATS}
    for ext in text_like - {".html", ".csv"}:
        assert rep[ext].n_ok == 1 and rep[ext].preview == f"Sample content for w{ext}\nLine two."
    assert rep[".html"].preview == "Sample content for w.html\nLine two."
    assert rep[".csv"].preview == "Sample content for w.csv\nLine two."
    assert rep[".ipynb"].preview == "# Notebook"
    assert rep[".json"].error_class == "bad_json"
    assert rep[".xml"].n_ok == 1 and rep[".xml"].n_chars == 0  # malformed: raw text, here ""
    for ext in (".docx", ".pdf", ".pptx", ".xlsx", ".yaml", ".yml"):
        assert rep[ext].error_class == "missing_dependency"
    assert all(r.all_ok is False for r in rep.values())


def test_oversized_files_are_quarantined(spark, tmp_path):
    (tmp_path / "small.txt").write_text("tiny")
    (tmp_path / "big.txt").write_text("x" * 5000)
    files = read_corpus(spark, str(tmp_path), max_bytes=1000)
    rows = {r.name: r for r in load_corpus_text(files).collect()}
    assert rows["small.txt"].text == "tiny"
    assert rows["big.txt"].error_class == "too_large" and rows["big.txt"].text is None
    plan = files.where("error_class = 'too_large'")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]  # no content read


def test_oversized_file_content_is_never_read(spark, tmp_path):
    (tmp_path / "small.txt").write_text("tiny")
    (tmp_path / "big.txt").write_text("x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:  # reading big.txt's content would now raise
        rows = {r.name: r for r in load_corpus_text(read_corpus(spark, str(tmp_path), max_bytes=2000)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows["big.txt"].error_class == "too_large" and rows["small.txt"].text == "tiny"
