"""Staleness checked again and again, on a clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.constants import STALE_POLL_MS
from sheaf.operators.stale import KEPT, advance_hashes, current_hashes, headlines, stale_files
from sheaf.session import folder_names, remove_folder


def check_now(snapshots: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Headline of every session; a fresh one has null status, so a sink can clear its display."""
    return _heads(snapshots, current_hashes(files), keys)


def _heads(snapshots, current, keys):
    heads = headlines(stale_files(snapshots, current), keys)
    return snapshots.select(*keys).distinct().join(heads, keys, "left")


def poll_staleness(
    spark: SparkSession,
    current_snapshots: Callable[[], DataFrame],
    current_files: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    keys: list[str],
    interval_ms: int = STALE_POLL_MS,
):
    """Start a query whose every tick lists the files again and hands the headlines to ``sink``.

    The rate source is only a clock.  A file stream would not do: it reports new paths, never
    edits or deletions.  ``current_snapshots`` gives the cursor states; while it returns None
    (nothing recorded, or a state is loading) the tick is skipped.
    """

    def tick(_: DataFrame, batch_id: int) -> None:
        snapshots = current_snapshots()
        if snapshots is not None:
            sink(check_now(snapshots, current_files(), keys).withColumn("tick", F.lit(batch_id)), batch_id)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=f"{interval_ms} milliseconds").start()


def kept_hashes(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The table of hashes that the last finished tick (before a given one) left; empty if there is none."""
    ticks = _ticks(spark, folder, before)
    return spark.read.schema(KEPT).parquet(f"{folder}/tick={ticks[-1]}") if ticks else spark.createDataFrame([], KEPT)


def _ticks(spark, folder, before=None):
    names = [n for n in folder_names(spark, folder) if n.startswith("tick=")]
    done = sorted(int(n[5:]) for n in names if "_SUCCESS" in folder_names(spark, f"{folder}/{n}"))
    return [t for t in done if before is None or t < before]


def poll_changes(
    spark: SparkSession,
    current_snapshots: Callable[[], DataFrame],
    list_now: Callable[[], DataFrame],
    read: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    keys: list[str],
    folder: str,
    marks: str,
    interval_ms: int = STALE_POLL_MS,
):
    """As ``poll_staleness``, but a tick reads only the files whose length or time changed since the tick before.

    ``list_now`` lists the files (path, is_dir, length, mtime) and ``read`` reads the listed ones it is given.  The hashes of all files are kept in ``folder``, one
    table a tick, written before the headlines go out.  A tick that is run again starts from the same table and replaces its own; the
    two last tables stay.  ``marks`` is the query's checkpoint, so that ticks go on counting after a restart.
    """

    def tick(_: DataFrame, batch_id: int) -> None:
        snapshots = current_snapshots()
        if snapshots is None:
            return
        advanced = advance_hashes(kept_hashes(spark, folder, batch_id), list_now(), read, batch_id)
        advanced.write.mode("overwrite").parquet(f"{folder}/tick={batch_id}")
        sink(_heads(snapshots, kept_hashes(spark, folder), keys).withColumn("tick", F.lit(batch_id)), batch_id)
        for old in _ticks(spark, folder)[:-2]:
            remove_folder(spark, f"{folder}/tick={old}")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    started = clock.writeStream.foreachBatch(tick).option("checkpointLocation", marks)
    return started.trigger(processingTime=f"{interval_ms} milliseconds").start()
