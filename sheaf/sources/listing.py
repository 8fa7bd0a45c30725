"""Directory listing as a Spark data source, and the listing-based readers.

``binaryFile`` leaves out names starting with ``_`` and empty files, which are ordinary
inputs here, so listings come from a Python data source.  It reads a file system that every
executor sees under the same path.  ``list_tree`` lists in rounds, also from object stores.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheaf import schema
from sheaf.functions.patterns import python_pattern
from sheaf.session import scratch_path
from sheaf.sources.stores import LocalStore, Stores

_PLAN_DIRS = 512
_MAX_PARTITIONS = 4096


def local_path(path: str) -> str:
    return path[len("file:") :] if path.startswith("file:") else path


class _Directories(InputPartition):
    """Directories listed by one task: with everything below them (deep) or their own entries only."""

    def __init__(self, paths: list[str], deep: bool):
        super().__init__(paths)
        self.paths, self.deep = paths, deep


class _Walk:
    """What to list: hidden entries, an ignore pattern and a depth, all pruned while walking."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.hidden = options.get("hidden", "false") == "true"
        depth = options.get("max_depth")
        self.max_depth = int(depth) if depth else None
        self.ignore = options.get("ignore") or None
        self.prune_dirs = options.get("prune_ignored_dirs", "false") == "true"

    def level(self, path):
        return 0 if path == self.root else path[len(self.root) :].count("/")

    def entries(self, directory, stores=None):
        """(listing row, is a directory to enter) for each entry; an unreadable one yields its error row."""
        ignore = re.compile(self.ignore) if self.ignore else None
        try:
            store = LocalStore() if stores is None else stores.of(directory)
            for entry in store.entries(directory):
                if not self.hidden and entry.name.startswith("."):
                    continue
                hit = ignore is not None and ignore.search(entry.path)
                if hit and (not entry.is_dir or self.prune_dirs):
                    continue
                enter = entry.is_dir and entry.error is None and (self.max_depth is None or self.level(entry.path) < self.max_depth)
                yield self._row(entry.path, entry.is_dir, entry.length, entry.mtime, entry.error), enter
        except OSError as e:
            yield self._row(directory, True, None, None, str(e)), False

    def folders(self, directory):
        """Directories to enter below this one, one at a time; used to plan the tasks."""
        ignore = re.compile(self.ignore) if self.ignore and self.prune_dirs else None
        try:
            found = os.scandir(directory)
        except OSError:
            return
        for entry in found:
            path = directory.rstrip("/") + "/" + entry.name
            wanted = self.hidden or not entry.name.startswith(".")
            if wanted and entry.is_dir(follow_symlinks=False) and not (ignore and ignore.search(path)):
                if self.max_depth is None or self.level(path) < self.max_depth:
                    yield path

    @staticmethod
    def _row(path, is_dir, length, mtime, error):
        folder, _, name = path.rpartition("/")
        return (path, folder or "/", name, is_dir, length, mtime, error)


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        """Split level by level until there are enough directories; the driver holds no more than that."""
        walk = _Walk(self.options)
        visited, frontier = [], [walk.root]
        while frontier and len(frontier) + len(visited) < _PLAN_DIRS:
            below, full = [], False
            for i, directory in enumerate(frontier):
                # a folder whose own folders do not fit the plan stays deep, and so do those after it
                more = list(islice(walk.folders(directory), _PLAN_DIRS + 1 - len(below)))
                if len(below) + len(more) > _PLAN_DIRS:
                    below, full = below + frontier[i:], True
                    break
                below += more
                visited.append(directory)
            frontier = below
            if full:
                break
        return self._spread(visited, deep=False) + self._spread(frontier, deep=True)

    @staticmethod
    def _spread(paths, deep):
        n = min(len(paths), _MAX_PARTITIONS)
        return [_Directories(paths[i::n], deep) for i in range(n)]

    def read(self, partition):
        walk = _Walk(self.options)
        pending = list(partition.paths)
        while pending:
            for row, enter in walk.entries(pending.pop()):
                yield row
                if enter and partition.deep:
                    pending.append(row[0])


class ListingSource(DataSource):
    """``spark.read.format("listing").load(dir)``: one row per entry, symlinked directories not followed."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return schema.LISTING

    def reader(self, schema):
        return ListingReader(self.options)


def list_directory(
    spark: SparkSession,
    root: str,
    ignore: str | None = None,
    hidden: bool = False,
    max_depth: int | None = None,
    prune_ignored_dirs: bool = False,
) -> DataFrame:
    """Every file and directory below ``root``; ``ignore`` goes into the walk itself.

    By default an ignore match drops files only, as a walk over dropped folders does; with
    ``prune_ignored_dirs`` a matching directory is not entered, as a tree does.
    """
    spark.dataSource.register(ListingSource)
    reader = spark.read.format("listing").option("hidden", str(hidden).lower())
    if ignore is not None:
        reader = reader.option("ignore", python_pattern(ignore) or "")
    if max_depth is not None:
        reader = reader.option("max_depth", str(max_depth))
    reader = reader.option("prune_ignored_dirs", str(prune_ignored_dirs).lower())
    return reader.load(local_path(root))


# Folders one task lists in a round before it hands on the rest.
FOLDERS_PER_TASK = 1024


def _list_some(options: dict, folders_per_task: int):
    """Folders (path, level) → their entries, and those below them as far as the budget goes; what remains comes out as folders to list."""
    names = [*schema.LISTING.names, "level", "pending"]
    types = [pa.string()] * 3 + [pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.int32(), pa.bool_()]

    def run(batches):
        walk, stores, held = _Walk(options), Stores(), []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held.clear()
            return batch

        for batch in batches:
            # the budget is shared by the folders of a batch, so that one among many small ones is handed on all the same
            todo = list(zip(batch.column("path").to_pylist(), batch.column("level").to_pylist()))
            listed = 0
            while todo and listed < max(folders_per_task, batch.num_rows):
                folder, level = todo.pop()
                listed += 1
                for row, enter in walk.entries(folder, stores):
                    held.append((*row, level + 1, False))
                    if enter:
                        todo.append((row[0], level + 1))
                    if len(held) >= 4096:
                        yield flush()
            for folder, level in todo:
                held.append((folder, None, None, True, None, None, None, level, True))
                if len(held) >= 4096:
                    yield flush()
        if held:
            yield flush()

    return run


def list_tree(
    spark: SparkSession,
    root: str,
    ignore: str | None = None,
    hidden: bool = False,
    max_depth: int | None = None,
    prune_ignored_dirs: bool = False,
    folders_per_task: int = FOLDERS_PER_TASK,
) -> DataFrame:
    """As ``list_directory``, for trees of any shape and for any store: ``root`` is a path, or a URI that Arrow's file systems know.

    The folders still to be listed are a table.  In each round they are dealt out evenly; a task lists up to ``folders_per_task`` of them, going
    down, and hands on the rest, so that a subtree with nearly all folders is soon spread over all tasks.  Each round's rows are written to the shared folder;
    a task that is run again lists its folders again.  The driver only sees how many folders remain.
    """
    options = {"path": root, "hidden": str(hidden).lower(), "prune_ignored_dirs": str(prune_ignored_dirs).lower()}
    options |= {} if ignore is None else {"ignore": python_pattern(ignore) or ""}
    options |= {} if max_depth is None else {"max_depth": str(max_depth)}
    out = T.StructType([*schema.LISTING.fields, T.StructField("level", T.IntegerType()), T.StructField("pending", T.BooleanType())])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out.fields])
    base = scratch_path(spark, "listing")
    folders = spark.createDataFrame([(_Walk(options).root, 0)], "path string, level int")
    remaining, done = 1, []
    while remaining:
        tasks = min(remaining, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-remaining // folders_per_task)))
        dealt = folders.repartition(tasks, F.xxhash64("path"))
        done.append(f"{base}/round={len(done)}")
        dealt.mapInArrow(_list_some(options, folders_per_task), out).write.parquet(done[-1])
        folders = spark.read.schema(out).parquet(done[-1]).where("pending").select("path", "level")
        remaining = folders.count()
    return spark.read.schema(out).parquet(*done).where("NOT pending").select(*schema.LISTING.names)
