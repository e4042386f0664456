"""Files out: whole or not at all, one text a target."""

import os

import pytest
from pyarrow import fs

from docweave.operators.output import export_files, export_report
from docweave.sources import storage

SCHEMA = "target_path string, saved_content string"


def test_report_tells_written_conflicting_and_failed_targets(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "file").write_text("in the way")
    (tmp_path / "old.md").write_text("a longer text than the new one")
    rows = [(at("a/b/c.md"), "é\r\n日本"), (at("twice.md"), "same"), (at("twice.md"), "same"), (at("two.md"), "one"), (at("two.md"), "other"),
            (at("file/below.md"), "x"), (at("old.md"), "new"), (None, "x"), (at("none.md"), None), (at("empty.md"), ""), ("file:" + at("uri.md"), "u")]
    got = {os.path.relpath(r.path.removeprefix("file:"), tmp_path): r for r in export_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n: (r.n_rows, r.status) for n, r in got.items()} == {
        "a/b/c.md": (1, "written"), "twice.md": (2, "written"), "two.md": (2, "conflict"), "file/below.md": (1, "failed"),
        "old.md": (1, "written"), "empty.md": (1, "written"), "uri.md": (1, "written")}
    assert (tmp_path / "a/b/c.md").read_bytes() == "é\r\n日本".encode() and (tmp_path / "old.md").read_text() == "new"
    assert not (tmp_path / "two.md").exists() and (tmp_path / "empty.md").read_bytes() == b""
    assert got["file/below.md"].error and got["two.md"].error
    assert export_files(spark.createDataFrame([], SCHEMA)) == 0


def test_a_write_that_dies_leaves_no_half_file(tmp_path, monkeypatch):
    class Dying:
        type_name = "local"

        def __init__(self):
            self.real = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.real, name)

        def move(self, a, b):
            raise KeyboardInterrupt

    target = tmp_path / "s.md"
    target.write_text("old")
    with pytest.raises(KeyboardInterrupt):
        storage.put(Dying(), str(target), b"new text")
    assert target.read_text() == "old" and os.listdir(tmp_path) == ["s.md"]
    storage.put(fs.LocalFileSystem(), str(target), b"new text")
    assert target.read_text() == "new text" and os.listdir(tmp_path) == ["s.md"]


def test_files_of_one_folder_grow_apart(tmp_path, monkeypatch):
    grown = []
    plain = storage.put
    monkeypatch.setattr(storage, "put", lambda store, path, data, parts=None: (grown.append(parts), plain(store, path, data, parts)))
    folders = [tmp_path / "full", tmp_path / "file:x", tmp_path / "lone"]
    with storage.Writer() as first, storage.Writer() as second:
        for k in range(4):
            first.put(f"{folders[0]}/a{k}.md", b"a")
            second.put(f"file:{folders[0]}/b{k}.md", b"b")
        first.put(f"{folders[1]}/c.md", b"c")
        first.put(f"{folders[2]}/d.md", b"d")
        first.put(f"{folders[0]}/a0.md", b"new")
        with pytest.raises(OSError):
            first.put(f"{folders[0]}/a1.md/below.md", b"x")
    own = [g for g in grown if g]
    assert len(set(own)) == 2 and len(own) == 7 and all(os.path.dirname(g) == str(folders[0]) for g in own)
    assert sorted(os.listdir(folders[0])) == [f"{c}{k}.md" for c in "ab" for k in range(4)]
    assert (folders[0] / "a0.md").read_bytes() == b"new" and os.listdir(folders[1]) == ["c.md"] and os.listdir(folders[2]) == ["d.md"]


def test_stores_of_paths_and_uris(tmp_path):
    for spelling in (f"{tmp_path}/x y.md", f"file:{tmp_path}/x y.md", f"file://{tmp_path}/x y.md"):
        store, path = storage.open_store(spelling)
        assert store.type_name == "local" and path == f"{tmp_path}/x y.md"
