"""Which files of a session are processed, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import MODE_ALL, MODE_SINGLE, ROWS_PER_SLICE
from sheaf.functions.paths import basename
from sheaf.operators.ordered import Ordered
from sheaf.operators.sizes import small_side


def dedupe_paths(selection: DataFrame) -> DataFrame:
    return selection.dropDuplicates(["session_id", "path"])


def with_order(selection: DataFrame, name: str = "ord", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add the 0-based place of each path in its session's sorted list (code-point order)."""
    return Ordered(selection, ["session_id"], ["path"], rows_per_slice).position(name).to_df()


def existing(selection: DataFrame, listing: DataFrame) -> DataFrame:
    """Selected paths that are regular files."""
    return selection.join(listing.where(~F.col("is_dir")).select("path"), "path", "left_semi")


def resolve_basenames(wanted: DataFrame, selection: DataFrame, order: str = "ord") -> DataFrame:
    """(session_id, name) → the first path of the list with that name; a full path resolves to itself.

    The first path is a ``min_by``: partial aggregation, no window over a popular name.
    """
    is_path = F.contains("name", F.lit("/"))
    by_name = (
        selection.withColumn("name", basename("path"))
        .groupBy("session_id", "name")
        .agg(F.min_by("path", order).alias("path"))
    )
    named = wanted.where(~is_path).join(by_name, ["session_id", "name"])
    full = wanted.where(is_path).withColumn("path", F.col("name")).join(
        selection.select("session_id", "path"), ["session_id", "path"], "left_semi"
    )
    return named.unionByName(full.select(named.columns))


def selected_file_problem(files: DataFrame, state: DataFrame) -> DataFrame:
    """Single-file sessions whose file cannot be shown: (session_id, message)."""
    single = state.where((F.col("mode") == MODE_SINGLE) & (F.col("selected_file") != ""))
    found = files.select("session_id", F.col("path").alias("selected_file"), "is_text")
    joined = single.join(found.dropDuplicates(["session_id", "selected_file"]), ["session_id", "selected_file"], "left")
    reason = F.when(F.col("is_text").isNull(), F.lit("not found")).when(~F.col("is_text"), F.lit("not a text file"))
    return joined.where(reason.isNotNull()).select(
        "session_id",
        F.concat(
            F.lit("# Error: Selected file "), basename("selected_file"), F.lit(" is "), reason, F.lit(".")
        ).alias("message"),
    )


def apply_mode(files: DataFrame, state: DataFrame) -> DataFrame:
    """Text files to process: one in single-file mode, else all; adds mode and selected_items.

    ``files`` needs (session_id, path, is_text).  State rows are one per session; a session
    without one is in all-files mode.
    """
    slim = state.select("session_id", "mode", "selected_file", "selected_items")
    # broadcast when small, so that contents are not shuffled by session
    joined = files.where("is_text").join(small_side(slim), "session_id", "left")
    single = (F.col("mode") == MODE_SINGLE) & F.coalesce(F.col("selected_file") != "", F.lit(False))
    return (
        joined.where(~F.coalesce(single, F.lit(False)) | (F.col("path") == F.col("selected_file")))
        .withColumn("mode", F.coalesce("mode", F.lit(MODE_ALL)))
        .withColumn("selected_items", F.coalesce("selected_items", F.array().cast("array<string>")))
        .drop("selected_file")
    )


def selection_changed(old_items, new_items, old_mode, new_mode, old_file, new_file) -> Column:
    """Items compared as sets; mode and file by value, null being a value."""

    def as_set(c):
        return F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))

    return (
        ~as_set(old_items).eqNullSafe(as_set(new_items))
        | ~F.col(old_mode).eqNullSafe(F.col(new_mode))
        | ~F.col(old_file).eqNullSafe(F.col(new_file))
    )


def membership(wanted: DataFrame, selection: DataFrame) -> DataFrame:
    """Add ``selected``: whether the (session_id, path) is in the selection."""
    marks = selection.select("session_id", "path").distinct().withColumn("__in", F.lit(True))
    joined = wanted.join(marks, ["session_id", "path"], "left")
    return joined.withColumn("selected", F.coalesce("__in", F.lit(False))).drop("__in")


def path_set(*arrays: str) -> Column:
    """Union of array columns as a sorted set."""
    out = F.coalesce(F.col(arrays[0]), F.array().cast("array<string>"))
    for name in arrays[1:]:
        out = F.array_union(out, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))
