"""Folders as a Spark data source: every name below some roots with its size and time; no content is read.

    spark.dataSource.register(FolderListing)
    spark.read.format("folder_listing").options(roots='["/data"]').load()

The driver walks the upper folders only, until there are ``PARTS`` of them; tasks walk what lies below, each holding one
folder's names at a time. All names are listed, also those that begin with ``_`` or ``.``, which Spark's own readers hide.
A file's identity is its exact URI. A folder that can't be read gives a row with ``error``; links to folders aren't
followed. As a stream, a batch holds the files that were written since the one before, up to ``SETTLED`` seconds ago.

Folders of the local kind are read by Python; others by the file systems that Arrow knows (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote_to_bytes, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, size long, mtime_ns long, uri string, error string"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("uri", pa.string()), ("error", pa.string())])
#: Folders that the driver looks for, partitions at most, and rows of a batch.
PARTS, ROWS = 256, 10_000
SETTLED = 1.0
KNOWN = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


class Entry(NamedTuple):
    """A file or folder; ``size`` is None for a folder."""

    path: str
    size: int | None
    mtime_ns: int
    uri: str


def scheme(root: str) -> str:
    part = urlsplit(root).scheme
    return part if len(part) > 1 else ""  # a letter is a drive


def is_local(uri: str) -> bool:
    return scheme(uri) in ("", "file")


def local_path(uri: str) -> str:
    """The path of a local URI or plain path; bytes that no text spells are kept."""
    return os.fsdecode(unquote_to_bytes(urlsplit(uri).path)) if scheme(uri) else uri


def local_uri(path: str) -> str:
    return "file://" + quote(os.fsencode(os.path.abspath(path)))


def shown(path: str) -> str:
    """A path as text; what isn't text in it is replaced."""
    return os.fsencode(path).decode("utf-8", "replace")


def _arrow(uri: str) -> tuple[pafs.FileSystem, str, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    base = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"
    return fs, path, base


def entries(folder: str) -> Iterator[Entry]:
    """What a folder holds, files and folders."""
    if is_local(folder):
        with os.scandir(local_path(folder)) as found:
            for item in found:
                if item.is_dir(follow_symlinks=False):
                    yield Entry(shown(item.path), None, 0, local_uri(item.path))
                elif item.is_file():
                    info = item.stat()
                    yield Entry(shown(item.path), info.st_size, info.st_mtime_ns, local_uri(item.path))
        return
    fs, path, base = _arrow(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield Entry(base + info.path, info.size if info.type == pafs.FileType.File else None, info.mtime_ns or 0, base + info.path)


def stat(uri: str) -> tuple[int, int] | None:
    """Size and time of a file; None if it is gone."""
    if is_local(uri):
        try:
            info = os.stat(local_path(uri))
        except OSError:
            return None
        return info.st_size, info.st_mtime_ns
    fs, path, _ = _arrow(uri)
    info = fs.get_file_info(path)
    return (info.size, info.mtime_ns or 0) if info.type == pafs.FileType.File else None


def content(uri: str) -> bytes:
    if is_local(uri):
        with open(local_path(uri), "rb") as f:
            return f.read()
    fs, path, _ = _arrow(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def write(uri: str, data: bytes) -> None:
    """Write a file and the folders above it."""
    if is_local(uri):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        return
    fs, path, _ = _arrow(uri)
    fs.create_dir(path.rpartition("/")[0])
    with fs.open_output_stream(path) as f:
        f.write(data)


class Folders(InputPartition):
    """Folders to walk; of those that the driver has opened only their own files are listed."""

    def __init__(self, whole: list[str], flat: list[str], since: int | None = None, until: int | None = None) -> None:
        super().__init__(0)
        self.whole, self.flat, self.since, self.until = whole, flat, since, until


def _deal(roots: list[str], subfolders: bool) -> list[tuple[list[str], list[str]]]:
    """(folders to walk, folders of which only the files count) for each partition."""
    opened, frontier = [], list(dict.fromkeys(local_uri(r) if is_local(r) and not scheme(r) else r.rstrip("/") for r in roots))
    if not subfolders:
        opened, frontier = frontier, []
    while frontier and len(frontier) < PARTS:
        below: list[str] = []
        for folder in frontier:
            opened.append(folder)
            try:
                below += [e.uri for e in entries(folder) if e.size is None]
            except OSError:
                pass  # its task tells
        frontier = sorted(below)
    n = min(PARTS, max(len(frontier), len(opened)))
    return [(frontier[i::n], opened[i::n]) for i in range(n)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def walk(part: Folders) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    stack = [(f, False) for f in part.flat] + [(f, True) for f in part.whole]
    while stack:
        folder, deep = stack.pop()
        try:
            for e in entries(folder):
                if e.size is None:
                    if deep:
                        stack.append((e.uri, True))
                elif (part.since is None or e.mtime_ns > part.since) and (part.until is None or e.mtime_ns <= part.until):
                    rows.append((*e, None))
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
        except OSError as x:
            rows.append((shown(local_path(folder)) if is_local(folder) else folder, None, None, folder, str(x)))
    if rows:
        yield _batch(rows)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], subfolders: bool) -> None:
        self.roots, self.subfolders = roots, subfolders

    def partitions(self) -> list[InputPartition]:
        return [Folders(*x) for x in _deal(self.roots, self.subfolders)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return walk(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, roots: list[str], subfolders: bool) -> None:
        self.roots, self.subfolders = roots, subfolders

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(SETTLED * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Folders(*x, start["until"], end["until"]) for x in _deal(self.roots, self.subfolders)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return walk(partition)


class FolderListing(DataSource):
    """Options: ``roots``, a JSON list, and ``subfolders``, true unless it says false."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self) -> tuple[list[str], bool]:
        return json.loads(self.options["roots"]), self.options.get("subfolders", "true").lower() != "false"

    def reader(self, schema) -> DataSourceReader:  # type: ignore[no-untyped-def]
        return _Reader(*self._asked())

    def streamReader(self, schema) -> DataSourceStreamReader:  # type: ignore[no-untyped-def]  # noqa: N802
        return _Stream(*self._asked())
