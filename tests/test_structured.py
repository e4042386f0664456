"""S6-S9 and A1-A4 against literal expectations."""

import io
import json
import os

from pyspark.sql import functions as F

from docweave.operators import assemble as A
from docweave.operators import structured as S


OUTLINES = {
    "<shelf room='2'><book lang='la'>De rerum</book></shelf>":
        '<shelf room="2">\n  <book lang="la">\n    De rerum\n  </book>\n</shelf>',
    "<shelf><book></shelf>": "<shelf><book></shelf>",
    "<p a='1' b='2'> one <i>two</i>after<hr/></p>":
        '<p a="1" b="2">\n  one\n  <i>\n    two\n  </i>\n  <hr>\n  </hr>\n</p>',
    "no markup": "no markup",
}
XMLS = list(OUTLINES)


def test_xml_outline(spark):
    deep = "<q>" * 40 + "</q>" * 40
    df = spark.createDataFrame([(x,) for x in [*XMLS, deep]], "x string")
    got = [r.o for r in df.select(S.xml_outline("x").alias("o")).collect()]
    assert got[:-1] == list(OUTLINES.values())
    assert got[-1].split("\n") == ["  " * i + "<q>" for i in range(40)] + ["  " * i + "</q>" for i in reversed(range(40))]


def test_xml_elements_rows(spark):
    df = spark.createDataFrame([(1, XMLS[0]), (2, XMLS[1])], "doc_id int, text string")
    rows = S.xml_elements(df).orderBy("doc_id", "seq").collect()
    assert [(r.kind, r.tag) for r in rows if r.doc_id == 1] == [
        ("open", "shelf"), ("open", "book"), ("text", "book"), ("close", "book"), ("close", "shelf")]
    assert rows[1].attrs == {"lang": "la"}
    assert [r.kind for r in rows if r.doc_id == 2] == ["raw"]


PREVIEWS = {
    "\n".join(f"{i};x,,{i * i}" for i in range(33)): "\n".join(f"{i};x, {i * i}" for i in range(20)),
    'p,"q,r",,s\r\n"two\nlines",t\r\n\r\nend,': "p, q,r, s\ntwo\nlines, t\n\nend",
    "": "",
    "alone": "alone",
}


def test_csv_preview(spark):
    df = spark.createDataFrame([(c,) for c in PREVIEWS], "c string")
    got = [r.p for r in df.select(S.csv_preview("c").alias("p")).collect()]
    assert got == list(PREVIEWS.values())


def test_csv_file_preview(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    for k in range(3):
        (d / f"f{k}.csv").write_text("\n".join(f"r{k}_{i},v{i},,x" for i in range(30)) + "\n")
    rows = S.csv_file_preview(spark, str(d / "*.csv")).collect()
    assert len(rows) == 3
    for r in rows:
        k = r.path.rsplit("f", 1)[1][0]
        assert r.preview == "\n".join(f"r{k}_{i}, v{i}, x" for i in range(20))


NOTEBOOKS = [
    ({"cells": [{"cell_type": "code", "source": ["a = 3\n", "a + 1"]},
                {"cell_type": "raw", "source": [" \n", "\t"]},
                {"cell_type": "markdown", "source": ["Some *notes*\n", "and more"]}]},
     "# code cell\n\na = 3\na + 1\n\nSome *notes*\nand more"),
    ({"cells": [{"cell_type": "markdown"}, {"cell_type": "code", "source": "y = 2"}]}, "# code cell\n\ny = 2"),
    ({"nbformat": 4}, ""),
    ({"cells": []}, ""),
]


def test_notebook_text(spark):
    df = spark.createDataFrame([(json.dumps(n),) for n, _ in NOTEBOOKS], "n string")
    got = [r.t for r in df.select(S.notebook_text("n").alias("t")).collect()]
    assert got == [t for _, t in NOTEBOOKS]


def test_table_preview_first_20_and_plan(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = S.table_preview(ev, ["user_id"], ["event_id"], ["event_id", "event_type"])
    pdf = ev.toPandas().sort_values("event_id")
    want = {u: "\n".join(f"{r.event_id}, {r.event_type}" for r in g.head(20).itertuples())
            for u, g in pdf.groupby("user_id")}
    got = {r.user_id: r.preview for r in out.collect()}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # first-20 cut before the shuffle


def test_assembly_rules(spark):
    paras = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 1, "  "), (2, 0, None), (2, 1, "\t")],
                                  "doc_id int, part_no int, text string")
    got = {r.doc_id: r.text for r in A.assemble_paragraphs(paras).collect()}
    assert got == {1: "a\n\nc", 2: ""}
    shapes = spark.createDataFrame(
        [(1, 1, 0, "t1"), (1, 1, 1, ""), (1, 2, 0, None), (1, 3, 0, "t3"), (2, 1, 0, None)],
        "doc_id int, slide_no int, shape_no int, text string")
    got = {r.doc_id: r.text for r in A.assemble_slides_from_shapes(shapes).collect()}
    assert got == {1: "Slide 1: t1\n\n\nSlide 3: t3", 2: ""}
    rows = spark.createDataFrame(
        [(1, "S1", 1, i, f"a{i}", None if i % 2 else f"b{i}") for i in range(25)]
        + [(1, "S0", 0, 0, None, None)],
        "doc_id int, sheet string, sheet_no int, row_no int, c1 string, c2 string")
    got = A.assemble_sheets(rows, ["doc_id"], "sheet", "sheet_no", ["row_no"], ["c1", "c2"]).first().text
    want_s1 = "\n".join(f"a{i}" if i % 2 else f"a{i}, b{i}" for i in range(20))
    assert got == "Sheet: S0\n\n\nSheet: S1\n" + want_s1


def test_join_parts_in_row(spark):
    df = spark.createDataFrame([(["p1", " ", "", "p2"],)], "a array<string>")
    assert df.select(A.join_parts("a").alias("t")).first().t == "p1\n\np2"


def test_csv_file_preview_reads_heads_only(spark, tmp_path):
    """Files of 20 and of 3,000 records, one of 3 GiB (sparse), and an empty one."""
    rows = [f"k{i:06d},{'x' * 40},,{i}" for i in range(3000)]
    head = "\n".join(f"k{i:06d}, {'x' * 40}, {i}" for i in range(20))
    for name in ("big.csv", "huge.csv"):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    os.truncate(tmp_path / "huge.csv", 3 << 30)
    (tmp_path / "small.csv").write_text("a,b\n,c\n")
    (tmp_path / "none.csv").touch()
    (tmp_path / "other.txt").write_text("not,asked,for")
    (tmp_path / "shut.csv").write_text("x,y")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.csv_file_preview(spark, str(tmp_path), glob="*.csv").collect()}
    assert {n: r.preview for n, r in got.items()} == {"big.csv": head, "huge.csv": head, "small.csv": "a, b\nc", "none.csv": "", "shut.csv": "x, y"}
    assert {r.error for r in got.values()} == {None}


def test_bytes_after_record_20_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

        read1 = read

    text = "".join(f'{i},"a ""quoted""\nbreak\r\nand more",é\r' for i in range(100_000))
    file = Counting(text.encode())
    preview, error = S.read_csv_head(file)
    assert error is None and preview == "\n".join(f'{i}, a "quoted"\nbreak\r\nand more, é' for i in range(20))
    assert file.taken <= 16_384
    assert S.read_csv_head(Counting(b"a,\xff\xfeb\n")) == ("a, ��b", None)
    assert S.read_csv_head(Counting(b'one,"open\nto the end')) == ("one, open\nto the end", None)
    long = '"' + "x" * 300_000 + '"'  # above the csv module's own limit of a field
    assert S.read_csv_head(Counting(long.encode()))[0] == "x" * 300_000


def test_assemble_pages_grouped_and_sheet_preview(spark):
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, None), (1, 0, "first"), (1, 3, "   ")],
                                  "doc_id int, page_no int, text string")
    assert A.assemble_pages(pages).first().text == "first\n\nsecond"
    rows = spark.createDataFrame([("w", "S", i, None if i == 1 else f"v{i}", i) for i in range(3)],
                                 "doc string, sheet string, r int, a string, b int")
    out = S.table_preview(rows, ["doc", "sheet"], ["r"], ["a", "b"], title_col="sheet", drop="null").first()
    assert out.preview == "Sheet: S\nv0, 0\n1\nv2, 2"


def test_csv_file_preview_follows_quotes(spark, tmp_path):
    raw = 'a,"multi\nline",b\r\nc,,d\n' + "\n".join(f"r{i},x" for i in range(30))
    (tmp_path / "q.csv").write_text(raw, newline="")
    got = S.csv_file_preview(spark, str(tmp_path / "q.csv")).first().preview
    assert got == "a, multi\nline, b\nc, d\n" + "\n".join(f"r{i}, x" for i in range(18))
