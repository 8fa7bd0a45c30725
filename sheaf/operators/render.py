"""Markdown blocks: one per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import BLOCK_ERROR, CODE_HEADING, IMPORTS_HEADING, SELECTED_HEADING
from sheaf.functions.paths import display_path, language
from sheaf.functions.text import content_hash, is_text, strip
from sheaf.functions.times import modified_line
from sheaf.operators.symbols import filter_decision, matched_symbols


def metadata(files: DataFrame, home: str, root: str = "root", reference_strict: bool = False) -> DataFrame:
    """The seven metadata columns of a file, plus session_id where present."""
    keep = ["session_id"] if "session_id" in files.columns else []
    return files.select(
        *keep,
        "path",
        display_path("path", root, home).alias("display_path"),
        is_text("content", reference_strict).alias("is_text_file"),
        language("path").alias("language"),
        F.col("mtime").alias("last_modified"),
        content_hash("content").alias("file_hash"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


def full_block(display, modified, lang, text) -> Column:
    """Heading, modified line, fenced text, and the blank line that parts it from the next block."""
    return F.concat(
        F.lit("# "), display, F.lit("\n"), modified, F.lit("\n\n```"), lang, F.lit("\n"), strip(text), F.lit("\n```\n\n")
    )


def filtered_block(display, modified, imports, matched) -> Column:
    """Selected definitions of a file after all of its imports, unfenced."""
    import_lines = F.concat(
        F.lit(f"\n\n{IMPORTS_HEADING}\n"), F.array_join(imports, "\n"), F.lit("\n")
    )
    code = F.array_join(F.transform(matched, lambda s: s["code"]), "\n\n")
    return F.concat(
        F.lit(CODE_HEADING),
        display,
        F.lit("\n"),
        modified,
        F.when(F.size(imports) > 0, import_lines).otherwise(F.lit("")),
        F.lit(f"\n{SELECTED_HEADING}\n"),
        strip(code),
        F.lit("\n\n\n"),
    )


def blocks(
    files: DataFrame,
    home: str,
    machine_time: bool = False,
    show_ellipsis: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """session_id, path, decision, block, error for rows chosen by ``apply_mode`` and parsed.

    Needs session_id, path, mtime, text, root, mode, selected_items and source.  A file that
    fails keeps its row: no block, an error text.
    """
    shown = files.select(
        "*",
        display_path("path", "root", home, show_ellipsis).alias("display"),
        modified_line("mtime", machine_time).alias("modified"),
        matched_symbols().alias("matched"),
    ).withColumn("decision", filter_decision(F.col("matched")))
    full = full_block(F.col("display"), F.col("modified"), language("path"), F.col("text"))
    part = filtered_block(F.col("display"), F.col("modified"), F.col("source.imports"), F.col("matched"))
    failed = F.col("decision") == "error"
    return shown.select(
        "session_id",
        "path",
        *(keep or []),
        "decision",
        F.when(F.col("decision") == "full", full).when(F.col("decision") == "filtered", part).alias("block"),
        F.when(failed, F.concat("display", F.lit(BLOCK_ERROR), "source.error")).alias("error"),
    )


