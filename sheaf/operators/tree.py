"""Directory trees as sorted, indented lines.

A node's sort key is its chain of sibling keys below the base, which follows from its own
path, so no sibling ranks are needed to order a tree.  "Last of its siblings" is an equality
with a per-directory maximum (partial aggregation).  Only directories are expanded to their
ancestors, and depth bounds that expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import PART_BYTES, ROWS_PER_SLICE, TREE_HEADING, TREE_MAX_DEPTH
from sheaf.functions.paths import ancestors, basename, components, parent, relative
from sheaf.functions.patterns import effective_pattern, ignored, matches_any_extension, python_pattern, search_any
from sheaf.operators.ordered import Ordered
from sheaf.operators.packing import concat_parts, number_parts
from sheaf.session import freeze

DENIED = "[permission denied]"


def listing_of_files(files: DataFrame, path: str = "path") -> DataFrame:
    """A listing (path, is_dir) with every directory above the given files."""
    return (
        files.select(F.posexplode(F.reverse(ancestors(path))).alias("up", "path"))
        .groupBy("path")
        .agg(F.min("up").alias("up"))
        .select("path", (F.col("up") > 0).alias("is_dir"), F.lit(None).cast("string").alias("error"))
    )


def _sibling_key(is_file, name) -> Column:
    return F.struct(is_file.cast("int").alias("file"), F.lower(name).alias("fold"), name.alias("name"))


def sort_key(rel, is_dir) -> Column:
    """Directories first, then lower-cased name, then name, level by level."""
    parts = components(rel)
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: _sibling_key(F.lit(0), p))
    own = _sibling_key(~is_dir, F.element_at(parts, -1))
    return F.concat(above, F.array(own))


def within_bases(listing: DataFrame, bases: DataFrame, max_depth: int = TREE_MAX_DEPTH) -> DataFrame:
    """Entries at most ``max_depth`` levels below one of the bases: base, node, is_dir, error, depth.

    Each entry looks up its few nearest ancestors; nothing is compared with every base.
    """
    up = F.slice(F.reverse(ancestors("path")), 2, max_depth)
    near = listing.select(F.col("path").alias("node"), "is_dir", "error", F.posexplode(up).alias("up", "base"))
    depth = (F.col("up") + 1).alias("depth")
    return near.join(bases.select("base").distinct(), "base").select("base", "node", "is_dir", "error", depth)


def drawable(listing: DataFrame, bases: DataFrame, pattern: str | None) -> DataFrame:
    """The bases that get a tree: none where the pattern is invalid, and none that is a file."""
    if python_pattern(pattern) is None:
        return bases.where(F.lit(False))
    files = listing.where(~F.col("is_dir")).select(F.col("path").alias("base")).distinct()
    return bases.join(files, "base", "left_anti")


def prune_ignored(nodes: DataFrame, pattern: str | None) -> DataFrame:
    """Drop nodes that match, or lie below a node that matches, on the absolute path."""
    hit = ignored(nodes.sparkSession, "node", pattern)
    if hit is None:
        return nodes
    if matches_any_extension(python_pattern(pattern)):
        # a matching ancestor shows in the node's own path: one test, pushed down to the listing
        return nodes.where(~hit)
    # a node and its few ancestors below the base
    above = F.filter(ancestors("node"), lambda p: F.length(p) > F.length(F.col("base")))
    try:
        effective = effective_pattern(nodes.sparkSession, pattern)
        return nodes.where(~F.exists(above, lambda p: p.rlike(effective)))
    except ValueError:
        joined = python_pattern(pattern)
        return nodes.where(~F.arrow_udf(lambda lists: search_any(lists, joined), "boolean")(above))


def tree_nodes(
    listing: DataFrame, bases: DataFrame, pattern: str | None = None, max_depth: int = TREE_MAX_DEPTH
) -> DataFrame:
    """base, node, parent, name, depth, is_dir, key, is_last."""
    return _mark_last(_keyed(listing, bases, pattern, max_depth))


def _keyed(listing, bases, pattern, max_depth):
    nodes = prune_ignored(within_bases(listing, bases, max_depth), pattern)
    keyed = nodes.select(
        "base",
        "node",
        parent("node").alias("parent"),
        basename("node").alias("name"),
        "depth",
        "is_dir",
        "error",
        sort_key(relative("node", "base"), F.col("is_dir")).alias("key"),
    )
    unreadable = keyed.where(F.col("is_dir") & F.col("error").isNotNull() & (F.col("depth") < max_depth))
    note = F.struct(F.lit(2).alias("file"), F.lit("").alias("fold"), F.lit(DENIED).alias("name"))
    notes = unreadable.select(
        "base",
        F.concat("node", F.lit("/"), F.lit(DENIED)).alias("node"),
        F.col("node").alias("parent"),
        F.lit(DENIED).alias("name"),
        (F.col("depth") + 1).alias("depth"),
        F.lit(False).alias("is_dir"),
        "error",
        F.concat("key", F.array(note)).alias("key"),
    )
    return keyed.unionByName(notes).drop("error")


def _last_keys(keyed):
    return keyed.groupBy("base", "parent").agg(F.max(F.element_at("key", -1)).alias("last_key"))


def _mark_last(keyed):
    last = F.element_at("key", -1) == F.col("last_key")
    return keyed.join(_last_keys(keyed), ["base", "parent"]).withColumn("is_last", last).drop("last_key")


def sibling_ranks(nodes: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``rank``: the 1-based place of a node among its siblings."""
    placed = nodes.withColumn("own_key", F.element_at("key", -1))
    ordered = Ordered(placed, ["base", "parent"], ["own_key"], rows_per_slice).position("rank")
    return ordered.to_df().withColumn("rank", (F.col("rank") + 1).cast("bigint")).drop("own_key")


def tree_lines(
    listing: DataFrame, bases: DataFrame, pattern: str | None = None, max_depth: int = TREE_MAX_DEPTH
) -> DataFrame:
    """base, node, depth, is_dir, is_last, key, line: the drawn tree without its root line."""
    # read four times below, and much narrower than the listing's source may be
    keyed = freeze(_keyed(listing, bases, pattern, max_depth))
    last_keys = _last_keys(keyed)
    dirs = freeze(
        keyed.where("is_dir")
        .join(last_keys, ["base", "parent"])
        .select("base", "node", "depth", (F.element_at("key", -1) == F.col("last_key")).alias("is_last"))
    )
    chain = dirs.select(
        "base",
        F.col("node").alias("dir"),
        F.explode(F.filter(ancestors("node"), lambda p: F.length(p) > F.length(F.col("base")))).alias("node"),
    )
    bar = F.when(F.col("is_last"), F.lit("    ")).otherwise(F.lit("│   "))
    # at most max_depth entries per directory
    steps = F.array_sort(F.collect_list(F.struct("depth", bar.alias("bar"))))
    indents = (
        chain.join(dirs, ["base", "node"])
        .groupBy("base", F.col("dir").alias("parent"))
        .agg(F.array_join(F.transform(steps, lambda s: s["bar"]), "").alias("indent"))
    )
    per_parent = last_keys.join(indents, ["base", "parent"], "left")
    is_last = F.element_at("key", -1) == F.col("last_key")
    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(is_last, F.lit("└── ")).otherwise(F.lit("├── ")),
        F.col("name"),
        F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")),
    )
    return keyed.join(per_parent, ["base", "parent"]).select(
        "base", "node", "depth", "is_dir", is_last.alias("is_last"), "key", line.alias("line")
    )


KEY_TYPE = "array<struct<file:int,fold:string,name:string>>"


def tree_rows(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """The whole tree section as ordered text rows per owner: owner columns, key, text.

    ``owners`` has a base, its display text and any further columns (such as session_id).
    """
    extra = [c for c in owners.columns if c not in ("base", "display")]
    head = owners.select(
        *extra,
        "base",
        F.array().cast(KEY_TYPE).alias("key"),
        F.concat(
            F.lit(TREE_HEADING), "display", F.lit("\n\n```text\n"), basename("base"), F.lit("/\n")
        ).alias("text"),
    )
    body = lines.join(owners, "base").select(
        *extra, "base", F.col("key").cast(KEY_TYPE).alias("key"), F.concat("line", F.lit("\n")).alias("text")
    )
    end_key = F.array(F.struct(F.lit(9).alias("file"), F.lit("").alias("fold"), F.lit("").alias("name")))
    tail = owners.select(*extra, "base", end_key.cast(KEY_TYPE).alias("key"), F.lit("```\n").alias("text"))
    return head.unionByName(body).unionByName(tail)


def tree_text(lines: DataFrame, owners: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The tree section per base, in parts: base, part, parts, rendered."""
    rows = tree_rows(lines, owners.select("base", "display")).withColumnRenamed("text", "rendered")
    numbered = number_parts(rows, ["base"], ["key"], F.octet_length("rendered"), "rendered", part_bytes)
    return concat_parts(numbered, ["base"], ["key"], "rendered")


def tree_snapshots(text: DataFrame, owners: DataFrame, pattern: str) -> DataFrame:
    """base, part, snapshot struct of each tree (the rendered text of a huge tree is in parts)."""
    return text.join(owners.select("base", "display"), "base").select(
        "base",
        "part",
        F.struct(
            F.col("base").alias("base_path"),
            F.col("display").alias("base_path_display"),
            F.lit(pattern).alias("ignore_regex"),
            F.col("rendered"),
        ).alias("tree"),
    )
