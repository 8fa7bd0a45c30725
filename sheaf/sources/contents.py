"""Late read of file contents: after all filters on the listing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import TEXT_CHECK_BYTES
from sheaf.session import freeze
from sheaf.sources.stores import Stores, read_head, read_rest

_BATCH_BYTES = 32 * 1024 * 1024
_COLUMNS = ["path", "content", "mtime", "length", "error"]

# Bytes one task should read; a hot folder is dealt out by this.
TASK_BYTES = 128 * 1024 * 1024
# Longest file that fits one row of a binary column, with room for its frame.
MAX_FILE_BYTES = 2**31 - 65_536


def _read_one(stores, path, length, max_bytes, text_only):
    try:
        with stores.of(path).open(path) as f:
            start = read_head(f, TEXT_CHECK_BYTES + 3)
            if text_only and b"\x00" in start[:TEXT_CHECK_BYTES]:
                return start, None
            whole = None if length is not None and length > max_bytes else read_rest(f, start, max_bytes)
            return (whole, None) if whole is not None else (None, "too large")
    except FileNotFoundError:
        return None, "missing"
    except OSError:
        return None, "error"


def _read_batches(max_bytes: int, text_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            start, rows, size = 0, [], 0
            for i, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())):
                rows.append(_read_one(stores, path, length, max_bytes, text_only))
                size += len(rows[-1][0] or b"")
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("path"),
                            pa.array([r[0] for r in rows], pa.binary()),
                            part.column("mtime"),
                            part.column("length"),
                            pa.array([r[1] for r in rows], pa.string()),
                        ],
                        names=_COLUMNS,
                    )
                    start, rows, size = i + 1, [], 0

    return run


def read_contents(
    listing: DataFrame, text_only: bool = False, task_bytes: int = TASK_BYTES, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """path, content, mtime, length, error for the listed files; a failing file keeps its row.

    ``error`` is 'missing', 'error' or 'too large' (over ``max_bytes``, which one row cannot hold, also if it grew since).  The listing is
    made once, as a narrow table, and dealt out by a hash of the path, so the files of one folder are read by many tasks.  ``text_only`` reads no more than the head
    of a file whose head holds a NUL.  Output batches are bounded by bytes, not by rows.
    """
    files = freeze(listing.where(~F.col("is_dir")).select("path", "mtime", "length"))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    read = _read_batches(max_bytes, text_only)
    return files.repartition(tasks, F.xxhash64("path")).mapInArrow(
        read, "path string, content binary, mtime timestamp, length bigint, error string"
    )
