"""Which files changed or disappeared since a snapshot."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import PART_BYTES, SHARD_ROWS, STALE_HEADLINES, STALE_TOOLTIP_HEAD
from sheaf.functions.paths import ancestors, parent
from sheaf.functions.text import content_hash, is_text
from sheaf.operators.packing import concat_parts, number_parts, number_shards
from sheaf.operators.sizes import small_side
from sheaf.session import freeze


def snapshot(files: DataFrame, reference_strict: bool = False) -> DataFrame:
    """(session_id, path, hash) of the text files of each session."""
    texts = files.where(is_text("content", reference_strict))
    return texts.select("session_id", "path", content_hash("content").alias("hash"))


def hash_maps(snapshots: DataFrame, keys: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The snapshot as maps path → hash; a key with very many files continues in further shards."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash"))))
    return (
        number_shards(snapshots, keys, "path", shard_rows)
        .groupBy(*keys, "shard")
        .agg(entries.alias("file_hashes"))
    )


def explode_hashes(states: DataFrame, keys: list[str]) -> DataFrame:
    """The stored maps of states as rows: keys…, path, hash."""
    return states.select(*keys, F.explode("file_hashes").alias("path", "hash"))


def current_hashes(files: DataFrame, reference_strict: bool = False) -> DataFrame:
    """(path, current_hash, readable, is_text) of the files as they are now, one row per path.

    A path is one file, however many sessions list it; only hashes are shuffled to say so.
    """
    readable = F.col("error").isNull() if "error" in files.columns else F.lit(True)
    now = F.struct(
        readable.alias("readable"),
        content_hash("content").alias("current_hash"),
        is_text("content", reference_strict).alias("is_text"),
    )
    return files.select("path", now.alias("now")).groupBy("path").agg(F.max("now").alias("now")).select("path", "now.*")


def stale_files(snapshots: DataFrame, current: DataFrame, reference_strict: bool = False) -> DataFrame:
    """Rows of the snapshot whose file is missing, unreadable or modified, with ``status``.

    New files are never reported.  A file that is gone or turned binary is reported as the
    documentation promises; ``reference_strict`` skips every file that is not text now.
    """
    joined = snapshots.join(current, "path", "left")
    status = (
        F.when(F.col("current_hash").isNull() & F.col("readable").isNull(), F.lit("missing"))
        .when(~F.col("readable"), F.lit("error"))
        .when(F.col("current_hash") != F.col("hash"), F.lit("modified"))
    )
    if reference_strict:
        joined = joined.where(F.col("is_text"))
    keep = [c for c in snapshots.columns if c != "hash"]
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).select(*keep, "status")


def stale_by_listing(snapshots: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``stale_files``, reading only the files whose length or time differs from the snapshot's.

    ``snapshots`` also holds length and mtime; ``read`` gives the contents (path, content, error) of listed
    files, as ``read_contents`` does.  A file rewritten with equal length and time counts as fresh.
    """
    now = listing.where(~F.col("is_dir")).groupBy("path").agg(
        F.max(F.struct(F.col("length").alias("now_length"), F.col("mtime").alias("now_mtime"))).alias("now")
    )
    joined = snapshots.join(now, "path", "left")
    gone = F.col("now").isNull()
    same = (F.col("now.now_length") == F.col("length")) & (F.col("now.now_mtime") == F.col("mtime"))
    doubted = joined.where(gone | ~F.coalesce(same, F.lit(False))).drop("now")
    there = listing.join(doubted.select("path").distinct(), "path", "left_semi")
    return stale_files(doubted.drop("length", "mtime"), current_hashes(read(there)))


KEPT = "path string, length bigint, mtime timestamp, current_hash string, readable boolean, is_text boolean, read_at bigint"


def advance_hashes(kept: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame], tick: int) -> DataFrame:
    """The hashes of all listed files, reading only those that are new or whose length or time differs (columns of KEPT).

    ``kept``: what the tick before gave; ``read`` gives the contents (path, content, error) of listed files.  ``read_at`` is the tick that read a file's content
    last.  A file that could not be read is read again; one that is not listed any more goes.
    """
    now = listing.where(~F.col("is_dir")).groupBy("path").agg(F.max(F.struct("length", "mtime")).alias("now"))
    before = kept.select("path", F.struct(*[c for c in kept.columns if c != "path"]).alias("kept"))
    both = freeze(now.join(before, "path", "left"))
    same = (F.col("kept.length") == F.col("now.length")) & (F.col("kept.mtime") == F.col("now.mtime")) & F.col("kept.readable")
    same = F.coalesce(same, F.lit(False))
    stay = both.where(same).select("path", "kept.*")
    differ = both.where(~same).select("path", "now.*")
    hashed = current_hashes(read(differ.withColumn("is_dir", F.lit(False))))
    fresh = differ.join(hashed, "path", "left").withColumns({"readable": F.coalesce("readable", F.lit(False)), "read_at": F.lit(tick).cast("bigint")})
    names = [f.split()[0] for f in KEPT.split(", ")]
    return stay.select(*names).unionByName(fresh.select(*names))


# ---- snapshots compared by folders ----


def folder_digests(hashes: DataFrame, keys: list[str]) -> DataFrame:
    """keys…, dir, parent, own, below: digests of each folder's own files, and of all files below it.

    ``hashes``: keys…, path, hash (null: unreadable).  A digest adds the hash limbs of its rows (as ``file_list_digest``), so folders add up to
    the folders above them: only one row a folder is exploded to its ancestors, never one a file.
    """
    row = F.sha2(F.to_json(F.struct("path", "hash"), {"ignoreNullFields": "false"}), 256)
    limbs = {f"__l{i}": F.conv(F.substring(row, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)") for i in range(5)}
    limbs["__l5"] = F.lit(1).cast("decimal(38,0)")
    add = [F.sum(name).alias(name) for name in limbs]
    own = hashes.select(*keys, parent("path").alias("dir"), *[limb.alias(name) for name, limb in limbs.items()]).groupBy(*keys, "dir").agg(*add)
    up = own.select(*keys, "dir", F.explode(ancestors("dir")).alias("above"), *limbs)
    mine = F.col("dir") == F.col("above")
    digest = lambda names: F.sha2(F.concat_ws(":", *names), 256)
    summed = up.groupBy(*keys, "above").agg(*add, *[F.sum(F.when(mine, F.col(n))).alias(f"{n}_own") for n in limbs])
    return summed.select(
        *keys,
        F.col("above").alias("dir"),
        F.when(F.col("above") != "/", parent("above")).alias("parent"),
        digest([f"{n}_own" for n in limbs]).alias("own"),
        digest(list(limbs)).alias("below"),
    )


def differing_folders(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """keys…, dir of the folders of ``before`` whose own files differ in ``now``: a descent from the top that enters differing folders only.

    Both: as ``folder_digests`` gives.  A folder of equal digest is equal down to the last file, so nothing below it is looked at.
    """
    level = before.where(F.col("parent").isNull()).select(*keys, "dir", "own", "below")
    found = []
    while True:
        other = now.select(*keys, "dir", F.col("own").alias("__own"), F.col("below").alias("__below"))
        differ = freeze(level.join(other, [*keys, "dir"], "left").where(~F.col("below").eqNullSafe(F.col("__below"))))
        if differ.isEmpty():
            break
        found.append(differ.where(~F.col("own").eqNullSafe(F.col("__own"))).select(*keys, "dir"))
        entered = differ.select(*keys, F.col("dir").alias("parent"))
        level = before.join(small_side(entered), [*keys, "parent"], "left_semi").select(*keys, "dir", "own", "below")
    none = before.where(F.lit(False)).select(*keys, "dir")
    return reduce(DataFrame.union, found, none)


def stale_by_digests(snapshots: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """As ``stale_files``, comparing folder digests first and files only in folders that differ.

    ``current``: path, current_hash, readable, is_text of the files as they are now, as ``current_hashes`` or ``advance_hashes`` give.  Files that no
    snapshot has are reported by neither.
    """
    mark = F.when(F.col("readable"), F.col("current_hash"))
    listed = snapshots.select(*keys, "path")
    now = listed.join(current.select("path", mark.alias("hash"), F.lit(True).alias("__there")), "path").drop("__there")
    folders = differing_folders(freeze(folder_digests(snapshots, keys)), freeze(folder_digests(now, keys)), keys)
    doubted = snapshots.withColumn("dir", parent("path")).join(small_side(freeze(folders)), [*keys, "dir"], "left_semi").drop("dir")
    return stale_files(doubted, current)


def headlines(stale: DataFrame, keys: list[str]) -> DataFrame:
    """keys…, headline, files: the gravest status decides."""
    rank = F.when(F.col("status") == "missing", 3).when(F.col("status") == "error", 2).otherwise(1)
    text = F.create_map(*[F.lit(v) for pair in STALE_HEADLINES.items() for v in pair])
    return (
        stale.groupBy(*keys)
        .agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("files"))
        .withColumn("headline", text[F.col("status")])
    )


def reports(stale: DataFrame, keys: list[str], display: str = "path", part_bytes: int = PART_BYTES) -> DataFrame:
    """The detail text of a staleness report, sorted by path, in parts: keys…, part, parts, report."""
    lines = stale.select(
        *keys,
        "path",
        F.concat(F.lit("\n- "), F.col(display), F.lit(" ("), "status", F.lit(")")).alias("report"),
    )
    heads = stale.select(*keys).distinct().select(
        *keys, F.lit("").alias("path"), F.lit(STALE_TOOLTIP_HEAD).alias("report")
    )
    rows = lines.unionByName(heads)
    numbered = number_parts(rows, keys, ["path"], F.octet_length("report"), "report", part_bytes)
    return concat_parts(numbered, keys, ["path"], "report")
