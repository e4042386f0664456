"""Zero-length files are documents: in the batch reader and in the stream."""

import os
import shutil

import pytest

from docweave.sources import listing
from docweave.sources.files import load_corpus_text, read_corpus
from docweave.streaming.incremental import run_incremental, run_incremental_report


@pytest.fixture()
def folder(tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/deep/er/c.md", "lang=en/d.txt", "_hidden/e.txt", ".f.txt", "_g.txt", "h.csv", "sp ace/é.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "full.txt").write_text("One. Two.")
    (tmp_path / "sub" / "full.md").write_text("Three.")
    return tmp_path


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_empty_files_are_read_by_default(spark, folder):
    files = read_corpus(spark, str(folder))
    assert names(files) == sorted(["a.txt", "b.txt", "c.md", "d.txt", "h.csv", "é.txt", "full.txt", "full.md"])
    rows = {r.path: r for r in files.collect()}
    assert all(p.startswith("file:/") for p in rows)  # both halves spell paths alike
    empty = rows[f"file:{folder}/sub/b.txt"]
    assert (empty.length, bytes(empty.content), empty.error_class) == (0, b"", None)
    assert abs(empty.modificationTime.timestamp() - (folder / "sub" / "b.txt").stat().st_mtime) < 2
    texts = {r.name: r for r in load_corpus_text(files).collect()}
    assert texts["a.txt"].text == "" and texts["c.md"].text == "" and texts["h.csv"].text == ""
    assert names(read_corpus(spark, str(folder), include_empty=False)) == ["full.md", "full.txt"]


def test_globs_wanted_and_overlapping_paths(spark, folder):
    assert names(read_corpus(spark, str(folder), glob="*.{md,csv}")) == ["c.md", "full.md", "h.csv"]
    assert names(listing.empty_files(spark, [str(folder / "sub"), str(folder / "sub" / "deep")])) == ["b.txt", "c.md"]
    assert names(listing.empty_files(spark, str(folder / "*" / "*.txt"))) == sorted(["b.txt", "d.txt", "e.txt", "é.txt"])
    assert names(listing.empty_files(spark, str(folder), recursive=False)) == ["a.txt", "d.txt", "h.csv"]
    got = read_corpus(spark, str(folder), wanted=[str(folder / "a.txt"), str(folder / "gone.txt")])
    assert [r.path for r in got.where("error_class = 'not_found'").collect()] == [f"file:{folder}/gone.txt"]
    assert names(listing.empty_files(spark, "file:" + str(folder / "a.txt"))) == ["a.txt"]


def test_many_folders_are_dealt(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"d{i}" / "x").mkdir(parents=True)
        (tmp_path / f"d{i}" / "x" / f"e{i}.txt").touch()
    found = listing.empty_files(spark, str(tmp_path))
    assert found.count() == 150
    parts = listing._Listing({"paths": f'["{tmp_path}"]'}).folders()
    assert sum(p.deep for p in parts) >= 64  # listed apart, on executors


def test_glob_patterns():
    fits = lambda g, n: bool(listing.glob_pattern(g).match(n))
    assert fits("*.txt", "a.txt") and not fits("*.txt", "a.txt2") and fits("part-?[0-9]*", "part-a1b") and not fits("[!a]b", "ab")
    assert fits("{a,b}*.md", "bc.md") and not fits("{a,b}*.md", "c.md") and fits("a+b.txt", "a+b.txt")


def test_stream_takes_empty_files_once(spark, tmp_path):
    src, sink, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    src.mkdir()
    (src / "none.txt").touch()
    (src / "some.txt").write_text("One. Two. Three.")
    run_incremental(spark, str(src), str(sink), str(ckpt))
    assert {(r.name, r.summary, r.n_chars) for r in spark.read.parquet(str(sink)).collect()} == {
        ("none.txt", "", 0), ("some.txt", "One. Two.", 16)}
    (tmp_path / "old.md").touch()
    os.utime(tmp_path / "old.md", (1_000_000, 1_000_000))
    shutil.move(str(tmp_path / "old.md"), str(src / "old.md"))  # comes with an old time
    (src / "new.txt").touch()
    run_incremental(spark, str(src), str(sink), str(ckpt))
    run_incremental(spark, str(src), str(sink), str(ckpt))
    assert sorted(r.name for r in spark.read.parquet(str(sink)).collect()) == ["new.txt", "none.txt", "old.md", "some.txt"]


def test_streaming_report_counts_empty_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").touch()
    (src / "b.txt").write_text("hello")
    (src / "c.json").touch()
    run_incremental_report(spark, str(src), str(tmp_path / "rep"), str(tmp_path / "ckpt"))
    rows = {r.ext: r for r in spark.read.parquet(str(tmp_path / "rep")).collect()}
    assert (rows[".txt"].n_files, rows[".txt"].n_ok, rows[".txt"].n_chars) == (2, 2, 5)
    assert (rows[".json"].n_files, rows[".json"].n_ok, rows[".json"].error_class) == (1, 0, "bad_json")


def test_no_list_of_files_on_the_driver(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"{i}.txt").write_text("" if i % 10 == 0 else f"Text {i}.")
    (tmp_path / "d1" / "_left.txt").write_text("hidden")
    files = read_corpus(spark, [str(tmp_path), str(tmp_path / "d3")], glob="*.txt")
    assert files.inputFiles() == []  # Spark's own reader would hold them all
    got = {os.path.basename(r.path): r for r in files.collect()}
    assert len(got) == 70 and files.count() == 70
    assert all(bytes(got[f"{i}.txt"].content) == (b"" if i % 10 == 0 else f"Text {i}.".encode()) for i in range(70))
    assert got["7.txt"].length == 7 and got["7.txt"].path == f"file:{tmp_path}/d7/7.txt"
    slim = read_corpus(spark, str(tmp_path), wanted=[str(tmp_path / "gone")], with_content=False)
    assert slim.where("content IS NOT NULL").count() == 0 and slim.where("length = 7").count() == 9
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_corpus(spark, str(tmp_path / "none"))


def test_contents_leave_a_task_in_pieces(spark, tmp_path, monkeypatch):
    for i in range(9):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (i * 1000))
    monkeypatch.setattr(listing, "CONTENT_BYTES", 5000)
    rows = listing.with_content(listing.listed_files(spark, str(tmp_path)).coalesce(1), max_bytes=7000).collect()
    assert {os.path.basename(r.path): r.content and bytes(r.content) for r in rows} == {
        f"{i}.bin": None if i == 8 else bytes([i]) * (i * 1000) for i in range(9)}
