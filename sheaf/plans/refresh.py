"""Refresh of packs that repeats only what changed: parts stored under a digest of what went into them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import NO_TEXT_FILES
from sheaf.functions.text import decode_text, non_blank_lines, rstrip
from sheaf.operators.history import file_list_digest
from sheaf.operators.packing import number, with_part
from sheaf.operators.render import blocks
from sheaf.operators.sizes import small_side
from sheaf.operators.symbols import with_source
from sheaf.plans.packs import FILES, PackOptions, kept_files, path_key, session_settings, weight
from sheaf.session import folder_names, freeze

BLOBS = "digest string, text string, errors array<struct<path:string,error:string>>, shown boolean, files bigint, tick bigint"


def stored_parts(spark, store: str) -> DataFrame:
    """The rendered parts of a store: digest, text, errors, shown, files (read to render it), tick (of the refresh that did)."""
    done = sorted(n for n in folder_names(spark, store) if n.startswith("tick=") and "_SUCCESS" in folder_names(spark, f"{store}/{n}"))
    if not done:
        return spark.createDataFrame([], BLOBS)
    return spark.read.schema(BLOBS).parquet(*[f"{store}/{n}" for n in done])


def refresh_parts(
    entries: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    roots: DataFrame,
    state: DataFrame,
    options: PackOptions,
    store: str,
    tick: int,
) -> DataFrame:
    """The packs that ``process_files`` gives for the files as they are now, without trees: session_id, part, parts, output_text, errors, line_count, tick.

    ``entries``: session_id, path, mtime, length, current_hash, is_text of all files (``advance_hashes`` keeps these up to date without rereading).  The
    parts are numbered from them alone.  A part has a digest of its paths, times, hashes and settings; if ``store`` holds the digest, its
    text is taken from there, and none of its files is read.  The files of the other parts are read by ``read`` (listing rows in; path, content out), rendered and added to
    the store below ``tick=…``, which a repeated refresh replaces.  ``tick`` of a part says which refresh rendered it.
    """
    spark = entries.sparkSession
    settings = session_settings(entries, roots, state, options)
    joined = kept_files(entries, roots, options).join(settings, "session_id")
    shown = joined.where(F.col("message").isNull() & (F.col("selected_file").isNull() | (F.col("path") == F.col("selected_file"))))
    narrow = freeze(shown.select(
        "session_id", F.lit(FILES).alias("section"), path_key("path").alias("key"), weight(F.col("length"), "path").alias("weight"),
        "path", "mtime", "length", "current_hash", "is_text", "root", "mode", "selected_items"))
    texts = narrow.where("is_text")
    parts = number(texts.select("session_id", "section", "key", "weight"), ["session_id"], ["section", "key"], "weight", options.part_bytes, options.rows_per_slice)
    placed = with_part(texts, parts).drop("parts")
    inputs = ["path", "mtime", "current_hash", "root", "mode", "selected_items"]
    same = F.concat_ws(":", "digest", F.to_json(F.struct("session_id")), F.lit(f"{options.home}:{options.machine_time}:{options.show_ellipsis}"))
    index = freeze(file_list_digest(placed, ["session_id", "part"], inputs).select("session_id", "part", F.sha2(same, 256).alias("digest")))
    missing = index.join(stored_parts(spark, store).where(F.col("tick") != tick).select("digest"), "digest", "left_anti")
    needed = freeze(placed.join(small_side(freeze(missing)), ["session_id", "part"]))
    listed = needed.select("path", "length", "mtime").dropDuplicates(["path"]).withColumn("is_dir", F.lit(False))
    contents = read(listed).select("path", "content")
    parsed = with_source(needed.join(contents, "path").withColumn("text", decode_text("content")), "selected_items")
    rendered = blocks(parsed, options.home, options.machine_time, options.show_ellipsis, keep=["digest", "key"])
    items = F.array_sort(F.collect_list(F.struct("key", F.coalesce("block", F.lit("")).alias("text"))))
    made = rendered.groupBy("digest").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), "").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("path", "error")))).alias("errors"),
        F.bool_or(F.coalesce(F.col("block") != "", F.lit(False))).alias("shown"),
        F.count(F.lit(1)).alias("files"),
        F.lit(tick).cast("bigint").alias("tick"),
    )
    made.write.mode("overwrite").parquet(f"{store}/tick={tick}")
    return _assembled(spark, index, narrow, settings, store)


def _assembled(spark, index, narrow, settings, store):
    """Packs of the indexed parts; those at a session's end that show nothing are merged, with their errors, into the last that does."""
    found = stored_parts(spark, store).dropDuplicates(["digest"])
    facts = freeze(index.join(found.select("digest", "shown", "errors"), "digest"))
    last = facts.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("shown"), F.col("part"))), F.lit(0)).alias("last"))
    ends = facts.join(last, "session_id").where("part >= last").groupBy("session_id", F.col("last").alias("part")).agg(
        (F.col("last") + 1).cast("bigint").alias("parts"), F.array_sort(F.flatten(F.collect_list("errors"))).alias("all_errors"))
    where = index.join(last, "session_id").where("part <= last").join(ends, ["session_id", "part"], "left")
    where = where.select("session_id", "part", "digest", (F.col("last") + 1).cast("bigint").alias("parts"), "all_errors", (F.col("part") == F.col("last")).alias("ends"))
    text = F.when(F.col("ends"), rstrip("text")).otherwise(F.col("text"))
    packs = found.drop("shown", "files").join(small_side(freeze(where)), "digest").select(
        "session_id", F.col("part").cast("bigint").alias("part"), "parts", text.alias("output_text"), F.coalesce("all_errors", "errors").alias("errors"), "tick")
    # sessions without any text file
    kinds = narrow.groupBy("session_id").agg(F.bool_or("is_text").alias("any_text"))
    bare = settings.join(kinds, "session_id", "left").where(~F.coalesce("any_text", F.lit(False)))
    note = F.coalesce("message", F.when(F.col("any_text").isNotNull(), F.lit(NO_TEXT_FILES)), F.lit(""))
    none = F.array().cast("array<struct<path:string,error:string>>")
    alone = bare.select(
        "session_id", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"), note.alias("output_text"), none.alias("errors"), F.lit(None).cast("bigint").alias("tick"))
    return packs.unionByName(alone).withColumn("line_count", non_blank_lines("output_text"))
