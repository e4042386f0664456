"""Files as rows, listed on the executors.

Spark's file sources list every file on the driver, hold the list there, and drop
zero-length files.  These sources list folders - their sub-folders in parallel,
on the executors - so that no list of files comes to the driver: ``listed_files``
has files of any length, ``with_content`` reads them where they were dealt, and
``empty_files`` has the zero-length files alone, in the columns of ``binaryFile``.
Hidden names (``_`` or ``.`` in front) are skipped as in Spark's sources, ``_``
not where the name is a partition folder's.

As a stream, every trigger lists again and yields all of them: the caller keeps
one of each path (``dropDuplicates``), so a file that is moved in with an old
time is seen too.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTED = "path string, modificationTime timestamp, length long"
SCHEMA = f"{LISTED}, content binary"
#: Folders are opened until there are so many to list apart.
FOLDERS = 64
#: Bytes of content that a task hands on at a time (one file at least).
CONTENT_BYTES = 8 << 20


def glob_pattern(glob: str) -> re.Pattern:
    """A file-name glob (``*``, ``?``, ``[a-z]``, ``{a,b}``) as a pattern."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return re.compile(out + ")" * depth + r"\Z", re.S)


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name


class _Entry(NamedTuple):
    path: str
    base_name: str
    is_dir: bool
    size: int
    mtime: object


def _entries(store, folder: str) -> Iterator[_Entry]:
    """What a folder holds; a local one is read as it is listed, however full."""
    import os
    from datetime import datetime, timezone

    from pyarrow import fs

    if store.type_name == "local":
        try:
            found = os.scandir(folder)
        except FileNotFoundError:
            return
        with found:
            for e in found:
                try:
                    is_dir, is_file, stat = e.is_dir(), e.is_file(), e.stat()
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
                if is_dir or is_file:
                    yield _Entry(posixpath.join(folder, e.name), e.name, is_dir, stat.st_size,
                                 datetime.fromtimestamp(stat.st_mtime_ns // 1_000_000 / 1000, timezone.utc))
        return
    for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if i.type in (fs.FileType.Directory, fs.FileType.File):
            yield _Entry(i.path, i.base_name, i.type == fs.FileType.Directory, i.size or 0, i.mtime)


def _uri(root: str, path: str) -> str:
    """A path of ``root``'s store as Spark spells it, and ``open_store`` reads it."""
    if "://" not in root or root.startswith("file:"):
        return "file:" + path
    scheme, rest = root.split("://", 1)
    return f"{scheme}://{rest.split('/', 1)[0] if path.startswith('/') else ''}{path}"


class _Folder(InputPartition):
    """A folder, or files, of the store that ``uri`` names."""

    def __init__(self, uri: str, path: str, recursive: bool, deep: bool) -> None:
        self.uri, self.path, self.recursive, self.deep = uri, path, recursive, deep


class _Listing:
    def __init__(self, options: dict) -> None:
        import json

        self.paths = json.loads(options["paths"])
        self.recursive = options.get("recursive", "true") == "true"
        self.glob = options.get("glob")
        self.empty = options.get("empty", "true") == "true"

    def folders(self) -> list[_Folder]:
        """Where to list; a folder is opened here as long as there are few."""
        from pyarrow import fs

        from docweave.sources.storage import open_store

        found: list[_Folder] = []
        for uri in self.paths:
            store, path = open_store(uri)
            for root in self._expand(store, path):
                queue = [root]
                while queue and len(queue) < FOLDERS:
                    folder = queue.pop(0)
                    found.append(_Folder(uri, folder, self.recursive, False))
                    info = store.get_file_info(folder)
                    if info.type == fs.FileType.Directory:
                        queue += [i.path for i in _entries(store, folder) if i.is_dir and self._enters(i.base_name)]
                found += [_Folder(uri, folder, self.recursive, True) for folder in queue]
        return found

    def _enters(self, name: str) -> bool:
        return not _hidden(name) and (self.recursive or "=" in name)

    def _expand(self, store, path: str) -> list[str]:
        """The paths that a path with globs stands for."""
        from pyarrow import fs

        if not re.search(r"[*?\[{]", path):
            return [path]
        parts = path.split("/")
        first = next(i for i, p in enumerate(parts) if re.search(r"[*?\[{]", p))
        found = ["/".join(parts[:first]) or "/"]
        for part in parts[first:]:
            fits = glob_pattern(part)
            found = [i.path for folder in found if store.get_file_info(folder).type == fs.FileType.Directory
                     for i in store.get_file_info(fs.FileSelector(folder)) if fits.match(i.base_name)]
        return found

    def read(self, part: _Folder) -> Iterator[tuple]:
        from datetime import datetime, timezone

        from pyarrow import fs

        from docweave.sources.storage import open_store

        store, _ = open_store(part.uri)
        fits = glob_pattern(self.glob) if self.glob else None
        queue = [part.path]
        while queue:
            at = queue.pop()
            info = store.get_file_info(at)
            named = info.type == fs.FileType.File
            for i in [_Entry(info.path, info.base_name, False, info.size, info.mtime)] if named else _entries(store, at):
                if i.is_dir:
                    if part.deep and self._enters(i.base_name):
                        queue.append(i.path)
                elif (i.size == 0 or not self.empty) and (named or not _hidden(i.base_name)):
                    if fits is None or fits.match(posixpath.basename(i.path)):
                        row = _uri(part.uri, i.path), i.mtime or datetime.fromtimestamp(0, timezone.utc), i.size
                        yield (*row, b"") if self.empty else row


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.listing = _Listing(options)

    def partitions(self) -> list[InputPartition]:
        return self.listing.folders()

    def read(self, partition: _Folder) -> Iterator[tuple]:
        return self.listing.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.listing = _Listing(options)

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        import time

        return {"listed": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.listing.folders()

    def read(self, partition: _Folder) -> Iterator[tuple]:
        return self.listing.read(partition)


class EmptyFiles(DataSource):
    """Options: ``paths`` (JSON list), ``glob`` (file names), ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "docweave_empty_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class ListedFiles(EmptyFiles):
    """The same options; files of any length, without their content."""

    def __init__(self, options: dict) -> None:
        super().__init__({**options, "empty": "false"})

    @classmethod
    def name(cls) -> str:
        return "docweave_listed_files"

    def schema(self) -> str:
        return LISTED


def _rows(spark: SparkSession, source, paths, glob: str | None, recursive: bool, stream: bool) -> DataFrame:
    import json

    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name()).option(
        "paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("recursive", str(recursive).lower())
    if glob:
        reader = reader.option("glob", glob)
    return reader.load()


def empty_files(spark: SparkSession, paths, glob: str | None = None, recursive: bool = True, stream: bool = False) -> DataFrame:
    """The zero-length files below ``paths``, one row a path."""
    rows = _rows(spark, EmptyFiles, paths, glob, recursive, stream)
    # paths that overlap, and every trigger of a stream, list a file again
    return rows.dropDuplicates(["path"]) if stream else rows.groupBy("path").agg(
        *[F.min(c).alias(c) for c in ("modificationTime", "length", "content")])


def listed_files(spark: SparkSession, paths, glob: str | None = None, stream: bool = False) -> DataFrame:
    """``LISTED`` of the files below ``paths``, one row a path, dealt by path: what
    follows (reading them) is spread however the folders are filled.  A stream
    keeps the paths that it has seen as its state, on the executors."""
    rows = _rows(spark, ListedFiles, paths, glob, True, stream)
    if stream:
        return rows.dropDuplicates(["path"])
    slots = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(slots, "path").groupBy("path").agg(*[F.min(c).alias(c) for c in ("modificationTime", "length")])


def with_content(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``SCHEMA`` of listed files: each is read by the task that has its row, some
    ``CONTENT_BYTES`` at a time; one above ``max_bytes`` has null content."""
    def run(batches):
        import pyarrow as pa

        from docweave.sources.storage import open_store

        def cut(batch, start, stop, data):
            piece = batch.slice(start, stop - start)
            return pa.RecordBatch.from_arrays([*piece.columns, pa.array(data, pa.binary())], names=[*piece.schema.names, "content"])

        for batch in batches:
            start, data, held = 0, [], 0
            for at, (path, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if data and held + length > CONTENT_BYTES:
                    yield cut(batch, start, at, data)
                    start, data, held = at, [], 0
                if max_bytes and length > max_bytes:
                    data.append(None)
                    continue
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    data.append(file.read())
                held += length
            yield cut(batch, start, batch.num_rows, data)

    return files.select("path", "modificationTime", "length").mapInArrow(run, SCHEMA)
