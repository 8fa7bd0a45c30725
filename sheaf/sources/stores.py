"""Where files lie: local folders, or any store that a URI names, seen alike by tasks.

A plain path is a folder that every executor sees under the same path.  A URI (``file:``, ``s3:``, ``gs:``, ``hdfs:`` …) goes through Arrow's
file systems, which read ranges of objects.  Neither leaves out names that start with ``_`` or empty files, as Spark's file sources do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple


class Entry(NamedTuple):
    """One entry of a folder; a failing one has an error and no length."""

    path: str
    name: str
    is_dir: bool
    length: int | None
    mtime: datetime | None
    error: str | None


def _when(ns: int) -> datetime:
    """A time of a file, whole microseconds."""
    return datetime.fromtimestamp(ns // 10**9, timezone.utc).replace(microsecond=ns % 10**9 // 1000)


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


class LocalStore:
    """Folders that are mounted under one path everywhere; linked folders are not followed."""

    def entries(self, folder: str) -> Iterator[Entry]:
        for found in os.scandir(folder):
            path = folder.rstrip("/") + "/" + found.name
            is_dir = found.is_dir(follow_symlinks=False)
            if not is_dir and not found.is_file():
                continue
            try:
                stat = found.stat()
                yield Entry(path, found.name, is_dir, None if is_dir else stat.st_size, _when(stat.st_mtime_ns), None)
            except OSError as e:
                yield Entry(path, found.name, is_dir, None, None, str(e))

    def open(self, path: str):
        return open(path, "rb")


class UriStore:
    """A store that Arrow reaches by a URI; paths keep the URI's head."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, inner = fs.FileSystem.from_uri(uri)
        inner = inner.rstrip("/")
        self.head = uri.rstrip("/").removesuffix(inner) if inner else uri.rstrip("/")
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.folder_type, self.file_type = fs.FileType.Directory, fs.FileType.File
        self.selector = fs.FileSelector

    def _inner(self, path: str) -> str:
        return path[len(self.head) :] or "/"

    def entries(self, folder: str) -> Iterator[Entry]:
        for found in self.system.get_file_info(self.selector(self._inner(folder), recursive=False)):
            is_dir = found.type == self.folder_type
            if not is_dir and found.type != self.file_type or is_dir and self.local and os.path.islink(found.path):
                continue
            when = None if found.mtime_ns is None else _when(found.mtime_ns)
            yield Entry(folder.rstrip("/") + "/" + found.base_name, found.base_name, is_dir, None if is_dir else found.size, when, None)

    def open(self, path: str):
        return self.system.open_input_file(self._inner(path))


def store_of(path: str):
    """The store that holds a path; a task asks once and uses it for all its files."""
    return UriStore(path) if is_uri(path) else LocalStore()


class Stores:
    """Stores by the head of their paths, opened when first needed."""

    def __init__(self):
        self._known = {}

    def of(self, path: str):
        head = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/*[^/]*", path).group() if is_uri(path) else ""
        if head not in self._known:
            self._known[head] = store_of(path)
        return self._known[head]


def read_head(source, size: int) -> bytes:
    """Up to ``size`` first bytes of an open file."""
    return source.read(size)


def read_rest(source, start: bytes, most: int) -> bytes | None:
    """The whole file, of which ``start`` is read; None if it holds more than ``most`` bytes, whatever a listing said."""
    rest = source.read(most + 1 - len(start))
    return None if len(start) + len(rest) > most else start + rest
