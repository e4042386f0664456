"""Files on shared storage as Python workers see them.

Spark's own readers and writers do everything that is a table.  What is not -
a reply kept the moment it is paid for, one file per summary, the head of a
file, files of no length - goes through pyarrow's file systems: local and
mounted folders, ``s3`` / ``s3a``, ``gs``, ``abfs`` and ``hdfs``.
"""

from __future__ import annotations

import os
import posixpath
import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri and not uri.startswith("file:"):
        scheme, rest = uri.split("://", 1)
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + "://" + rest)
    path = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
    return fs.LocalFileSystem(), os.path.abspath(path)


def _grows(store: fs.FileSystem) -> bool:
    """Whether a file system shows files as they grow."""
    return store.type_name in ("local", "hdfs")


def put(store: fs.FileSystem, path: str, data: bytes, parts: str | None = None) -> None:
    """Write a whole file or none: where a file system shows files as they grow,
    they grow under a hidden name and are renamed; objects appear when complete.
    An existing file is replaced, missing folders are made.  ``parts``: an
    existing folder to grow in, on the same file system."""
    folder, name = posixpath.split(path)
    if not _grows(store):
        with store.open_output_stream(path) as out:
            out.write(data)
        return
    if parts is None:
        store.create_dir(folder, recursive=True)
    part = posixpath.join(parts or folder, f".{name}.{uuid.uuid4().hex[:12]}.part")
    try:
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise


class Writer:
    """``put`` for the many files of a task.  Tasks that fill one folder wait for
    each other with every name that they make or change in it: from the second
    file of a folder on, files grow in a hidden folder of the task's own below it
    and only their renaming is left.  Those folders go when the writer closes."""

    def __init__(self) -> None:
        self.stores: dict[str, fs.FileSystem] = {}
        self.parts: dict[tuple[str, str], str | None] = {}

    def __enter__(self) -> Writer:
        return self

    def put(self, uri: str, data: bytes) -> None:
        store, path = open_store(uri)
        root = uri.split("://", 1)[0] + "://" + uri.split("://", 1)[1].split("/", 1)[0] if "://" in uri else ""
        store = self.stores.setdefault(root, store)
        key = root, posixpath.dirname(path)
        if _grows(store) and key in self.parts and self.parts[key] is None:
            own = posixpath.join(key[1], f".{uuid.uuid4().hex[:12]}.parts")
            store.create_dir(own)
            self.parts[key] = own
        put(store, path, data, self.parts.get(key))
        self.parts.setdefault(key, None)

    def __exit__(self, *_) -> None:
        for (root, _), own in self.parts.items():
            if own is not None:
                try:
                    self.stores[root].delete_dir(own)
                except FileNotFoundError:
                    pass


def exists(spark, uri: str) -> bool:
    """Whether a path exists, as Spark's file system layer sees it (driver)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def remove(spark, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def check_paths(spark, paths) -> None:
    """Fail as Spark's readers do where a path, or a glob, stands for nothing (driver)."""
    from pyspark.errors import AnalysisException

    for uri in [paths] if isinstance(paths, str) else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {uri}.")
