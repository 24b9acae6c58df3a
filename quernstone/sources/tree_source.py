"""Trees of source files as a data source of Spark's, in batches and as a stream.

Folders that are skipped are never listed and links never followed. The driver lists a tree
only as far down as it takes to have work for all tasks; each task then walks its own
folders. A stream takes the files whose time of change lies beyond that of the last run.

``register(spark)``, then ``spark.read.format("source_tree").option("path", ...)``. Paths are
file systems that executors can open themselves: mounted ones, or with a scheme that Arrow
knows. ``read_tree`` reads all others through Spark's readers.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from quernstone.functions import fixed

SCHEMA = "source string, length long, modified timestamp, text string"


@dataclass
class _Folders(InputPartition):
    """Folders to walk, and files that lie above them, of one task."""

    folders: list[str] = field(default_factory=list)
    files: list[tuple[str, int, int]] = field(default_factory=list)
    after: int = -1
    until: int | None = None


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


def listed(files: pyarrow.fs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(folders worth entering, files worth reading with size and time) of one folder."""
    folders, found = [], []
    for info in files.get_file_info(pyarrow.fs.FileSelector(folder)):
        if isinstance(files, pyarrow.fs.LocalFileSystem) and os.path.islink(info.path):
            continue
        if info.type == pyarrow.fs.FileType.Directory:
            if info.base_name not in fixed.SKIP_DIRS:
                folders.append(info.path)
        elif info.type == pyarrow.fs.FileType.File and not info.base_name.startswith(".") and info.base_name not in fixed.SKIP_FILES:
            if info.extension.lower() in fixed.EXTENSIONS and info.size <= fixed.MAX_FILE_BYTES:
                found.append((info.path, info.size, info.mtime_ns or 0))
    return sorted(folders), sorted(found)


def walked(files: pyarrow.fs.FileSystem, folders: list[str]) -> Iterator[tuple[str, int, int]]:
    waiting = list(reversed(folders))
    while waiting:
        inner, found = listed(files, waiting.pop())
        yield from found
        waiting += reversed(inner)


def dealt(files: pyarrow.fs.FileSystem, root: str, parts: int) -> list[_Folders]:
    """The tree in at most about ``parts`` shares, after listing as few folders as give so many."""
    front, loose = [root], []
    while front and len(front) < parts:
        deeper: list[str] = []
        for folder in front:
            inner, found = listed(files, folder)
            loose += found
            deeper += inner
        if not deeper:
            front = []
            break
        front = deeper
    shares = [_Folders() for _ in range(max(1, min(parts, len(front) + len(loose))))]
    for k, folder in enumerate(front):
        shares[k % len(shares)].folders.append(folder)
    for k, file in enumerate(loose):
        shares[-1 - k % len(shares)].files.append(file)
    return shares


class _Reader:
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("parts", 64))
        self.most, self.prefix = None, ""

    def rows(self, share: _Folders) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for found in (share.files, walked(files, share.folders)):
            for path, size, changed in found:
                if changed <= share.after or (share.until is not None and changed > share.until):
                    continue
                if (self.most is not None and size > self.most) or not path.startswith(self.prefix):
                    continue
                with files.open_input_file(path) as file:
                    text = file.read().decode("utf-8", "replace")
                yield path, size, datetime.datetime.fromtimestamp(changed / 1e9, datetime.UTC), text


class TreeReader(_Reader, DataSourceReader):
    """Sizes and beginnings of paths that are asked for decide before a file is opened."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("length",):
                bound = f.value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            elif isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("source",) and isinstance(f.value, str) and f.value.startswith(self.prefix):
                self.prefix = f.value
                if isinstance(f, EqualTo):
                    yield f  # a beginning alone doesn't decide
            else:
                yield f

    def partitions(self):
        files, root = opened(self.path)
        return dealt(files, root, self.parts)

    def read(self, partition):
        return self.rows(partition)


class TreeStreamReader(_Reader, DataSourceStreamReader):
    """An offset is the latest time of change, in nanoseconds."""

    def initialOffset(self):
        return {"changed": -1}

    def latestOffset(self):
        files, root = opened(self.path)
        return {"changed": max((changed for _, _, changed in walked(files, [root])), default=-1)}

    def partitions(self, start, end):
        files, root = opened(self.path)
        shares = dealt(files, root, self.parts)
        for share in shares:
            share.after, share.until = start["changed"], end["changed"]
        return shares

    def read(self, partition):
        return self.rows(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known, and has Spark hand it filters, which it asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
