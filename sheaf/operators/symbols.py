"""Classes, functions and imports of Python files: one parse per file, then relational work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import MODE_SINGLE, SHARD_ROWS
from sheaf.functions.paths import basename
from sheaf.functions.pysource import parse_source
from sheaf.operators.filters import is_python
from sheaf.operators.packing import number_shards


def with_source(files: DataFrame, wanted=None, text: str = "text", path: str = "path") -> DataFrame:
    """Add ``source``: what each ``.py`` file defines (null for other files).

    Only the text of ``.py`` rows crosses to Python.  ``wanted``: see ``parse_source``.
    """
    py_text = F.when(is_python(path), F.col(text))
    return files.withColumn("source", parse_source(basename(path), py_text, wanted))


def symbols(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per definition in source order: keep…, ord, kind, name, code."""
    return parsed.select(*keep, F.posexplode("source.symbols").alias("ord", "s")).select(*keep, "ord", "s.*")


def imports(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per distinct import statement of a file."""
    return parsed.select(*keep, F.explode("source.imports").alias("stmt"))


def import_names(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per imported name: keep…, alias, origin."""
    return parsed.select(*keep, F.explode("source.import_names").alias("n")).select(*keep, "n.*")


def session_imports(parsed: DataFrame) -> DataFrame:
    """Distinct import statements of each session."""
    return imports(parsed, ["session_id"]).distinct()


def parse_errors(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Files that could not be parsed: keep…, message."""
    failed = parsed.where(F.col("source.error").isNotNull())
    return failed.select(*keep, error_message().alias("message"))


def error_message() -> Column:
    """What a file that could not be parsed is reported with."""
    return F.concat(basename("path"), F.lit(": "), F.col("source.error"))


def names_of(kind: str) -> Column:
    """Names of one kind in source order, duplicates kept; empty, not null, when there are none."""
    chosen = F.filter("source.symbols", lambda s: s["kind"] == kind)
    return F.coalesce(F.transform(chosen, lambda s: s["name"]), F.array().cast("array<string>"))


def symbol_lists(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Per parsable file: keep…, classes, functions, imports (arrays)."""
    return parsed.where(F.col("source").isNotNull() & F.col("source.error").isNull()).select(
        *keep,
        names_of("class").alias("classes"),
        names_of("function").alias("functions"),
        F.col("source.imports").alias("imports"),
    )


def symbol_response(parsed: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per session the map path → {classes, functions}; a big session continues in further shards."""
    rows = symbol_lists(parsed, ["session_id", "path"])
    entry = F.struct("path", F.struct("classes", "functions").alias("names"))
    return (
        number_shards(rows, ["session_id"], "path", shard_rows)
        .groupBy("session_id", "shard")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("symbols"))
    )


def session_flags(parsed: DataFrame) -> DataFrame:
    """Per session: are there Python text files, was any symbol found, did any file fail.

    ``parsed``: all files of the sessions, with is_text and source; one aggregate.
    """
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return parsed.groupBy("session_id").agg(
        flag(is_python() & F.col("is_text")).alias("has_python_text_files"),
        flag(F.size("source.symbols") > 0).alias("found_symbols"),
        flag(F.col("source.error").isNotNull()).alias("has_errors"),
    )


def matched_symbols() -> Column:
    """Symbols of the row's file that its session selected, in source order."""
    return F.filter("source.symbols", lambda s: F.array_contains("selected_items", s["name"]))


def filter_decision(matched: Column | None = None) -> Column:
    """'full', 'filtered', 'none' or 'error' for a row with source, mode and selected_items."""
    none_matched = F.coalesce(F.size(matched_symbols() if matched is None else matched) == 0, F.lit(True))
    return (
        F.when(F.col("source.error").isNotNull(), F.lit("error"))
        .when(F.col("source").isNull() | (F.size("selected_items") == 0), F.lit("full"))
        .when(~none_matched, F.lit("filtered"))
        .when(F.col("mode") == MODE_SINGLE, F.lit("none"))
        .otherwise(F.lit("full"))
    )
