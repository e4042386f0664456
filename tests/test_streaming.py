"""The incremental job: new files only, restart-safe."""

from pyspark.sql import functions as F

from docweave.functions.text import local_summary
from docweave.streaming.incremental import run_incremental


def test_incremental_picks_up_new_files_once(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    (src / "a_first-doc.txt").write_text("One. Two. Three.")
    (src / "b.html").write_text("<p>Hello there. General.</p>")
    run_incremental(spark, str(src), str(sink), str(ckpt))
    first = spark.read.parquet(str(sink))
    assert first.count() == 2
    (src / "c.json").write_text('{"k": 1}')
    (src / "d.bin").write_text("x")
    run_incremental(spark, str(src), str(sink), str(ckpt))
    rows = {r.name: r for r in spark.read.parquet(str(sink)).collect()}
    assert len(rows) == 4  # the first two were not read again
    assert rows["a_first-doc.txt"].summary == "One. Two." and rows["a_first-doc.txt"].title == "a first doc"
    assert rows["b.html"].summary == "Hello there. General."
    assert rows["d.bin"].error_class == "unsupported_type" and rows["d.bin"].summary is None
    want = spark.createDataFrame([('{\n  "k": 1\n}',)], "t string").select(local_summary("t")).first()[0]
    assert rows["c.json"].summary == want


def test_incremental_loader_report(spark, tmp_path):
    from docweave.streaming.incremental import run_incremental_report
    src, rep, ckpt = tmp_path / "in", tmp_path / "report", tmp_path / "ckpt"
    src.mkdir()
    (src / "a.txt").write_text("hello")
    (src / "b.json").write_text('{"k": 1}')
    run_incremental_report(spark, str(src), str(rep), str(ckpt))
    first = {r.ext: r for r in spark.read.parquet(str(rep)).collect()}
    assert first[".txt"].n_files == 1 and first[".txt"].all_ok is True
    (src / "c.txt").write_text("world!")
    (src / "d.json").write_text("{broken")
    run_incremental_report(spark, str(src), str(rep), str(ckpt))
    rows = {r.ext: r for r in spark.read.parquet(str(rep)).collect()}
    assert (rows[".txt"].n_files, rows[".txt"].n_chars) == (2, 11)  # running totals
    assert rows[".json"].n_ok == 1 and rows[".json"].error_class == "bad_json"
    assert rows[".txt"].all_ok is False


def test_stream_quarantines_oversized_files(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    (src / "small.txt").write_text("One. Two. Three.")
    (src / "big.txt").write_text("x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:  # reading big.txt's content would now raise
        run_incremental(spark, str(src), str(sink), str(ckpt), max_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    rows = {r.name: r for r in spark.read.parquet(str(sink)).collect()}
    assert rows["small.txt"].summary == "One. Two."
    assert rows["big.txt"].error_class == "too_large" and rows["big.txt"].summary is None


def test_the_stream_lists_on_executors(spark, tmp_path):
    from docweave.streaming.incremental import file_stream
    (tmp_path / "a.txt").write_text("One.")
    plan = file_stream(spark, str(tmp_path))._jdf.queryExecution().logical().toString()
    assert "FileSource" not in plan and "binaryFile" not in plan  # these list, and keep every path, on the driver
