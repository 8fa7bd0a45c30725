"""Queries: directory trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from sheaf.functions.paths import display_path
from sheaf.operators.ordered import key_sizes
from sheaf.operators.tree import (
    prune_ignored,
    sibling_ranks,
    tree_lines,
    tree_nodes,
    tree_snapshots,
    tree_text,
    within_bases,
)

from sheaf.session import freeze


def bases(spark, sf):
    return V.documents(spark, sf).select("source").distinct().selectExpr(
        "source AS session_id", "'/home/u/code/' || source AS base"
    )


NODES = f"""levels AS (SELECT session_id, '/home/u/code/' || session_id AS base, path, string_split(path, '/') AS p
  FROM fx_files),
all_nodes AS (
  SELECT DISTINCT base, base || '/' || p[6] AS node, base AS parent, p[6] AS name, 1 AS depth, true AS is_dir,
    ['0' || lower(p[6]) || chr(1) || p[6]] AS key FROM levels
  UNION ALL SELECT DISTINCT base, base || '/' || p[6] || '/' || p[7], base || '/' || p[6], p[7], 2, true,
    ['0' || lower(p[6]) || chr(1) || p[6], '0' || lower(p[7]) || chr(1) || p[7]] FROM levels
  UNION ALL SELECT base, path, base || '/' || p[6] || '/' || p[7], p[8], 3, false,
    ['0' || lower(p[6]) || chr(1) || p[6], '0' || lower(p[7]) || chr(1) || p[7], '1' || lower(p[8]) || chr(1) || p[8]]
    FROM levels),
nodes AS (SELECT *, row_number() OVER (PARTITION BY base, parent ORDER BY key) AS rank,
    row_number() OVER (PARTITION BY base, parent ORDER BY key DESC) = 1 AS is_last
  FROM all_nodes WHERE NOT regexp_matches(node, '{V.IGNORE_DEFAULT}'))"""

LINES = """lines AS (SELECT n.base, n.node, n.key,
    CASE WHEN n.depth = 3 THEN CASE WHEN g.is_last THEN '    ' ELSE '│   ' END ELSE '' END
    || CASE WHEN n.depth >= 2 THEN CASE WHEN p.is_last THEN '    ' ELSE '│   ' END ELSE '' END
    || CASE WHEN n.is_last THEN '└── ' ELSE '├── ' END || n.name || CASE WHEN n.is_dir THEN '/' ELSE '' END AS line
  FROM nodes n LEFT JOIN nodes p ON p.base = n.base AND p.node = n.parent
    LEFT JOIN nodes g ON g.base = p.base AND g.node = p.parent)"""

BASE_DISPLAY = """CASE CAST(substr(base, 17) AS INT) % 4 WHEN 1 THEN '~/code/' || substr(base, 14)
  WHEN 3 THEN '~/code/' || substr(base, 14) ELSE '~/code/' || substr(base, 14) || '/' END"""
TREES = f"""trees AS (SELECT base, {BASE_DISPLAY} AS shown, '# Folder Tree of ' || {BASE_DISPLAY} || chr(10) || chr(10)
    || '```text' || chr(10) || substr(base, 14) || '/' || chr(10) || string_agg(line || chr(10), '' ORDER BY key)
    || '```' || chr(10) AS rendered FROM lines GROUP BY base)"""


def _nodes(spark, sf, **kw):
    return tree_nodes(V.listing(spark, sf), bases(spark, sf), **kw)


@query("w4_tree_nodes", f"""
WITH {V.FX_FILES}, {NODES} SELECT base, node, parent, name, depth, is_dir, is_last FROM nodes""")
def _(spark, sf):
    return _nodes(spark, sf).drop("key")


@query("o2_sibling_rank", f"WITH {V.FX_FILES}, {NODES} SELECT base, node, rank FROM nodes")
def _(spark, sf):
    return sibling_ranks(_nodes(spark, sf)).select("base", "node", "rank")


@query("o2_sibling_rank_sliced", f"WITH {V.FX_FILES}, {NODES} SELECT base, node, rank FROM nodes")
def _(spark, sf):
    nodes = freeze(_nodes(spark, sf))
    biggest, _ = key_sizes(nodes, ["base", "parent"])
    return sibling_ranks(nodes, rows_per_slice=max(1, biggest // 3)).select("base", "node", "rank")


@query("o3_depth_limit", f"WITH {V.FX_FILES}, {NODES} SELECT base, node, depth FROM nodes WHERE depth <= 2")
def _(spark, sf):
    return _nodes(spark, sf, max_depth=2).select("base", "node", "depth")


@query("j5_ancestor_prune", f"""
WITH {V.FX_FILES}, {NODES} SELECT base, node FROM all_nodes
WHERE NOT regexp_matches(node || '/', '/(tmp|de|es)/')
UNION ALL SELECT DISTINCT base, base || '/.git' FROM levels WHERE CAST(substr(session_id, 4) AS INT) % 2 = 0""")
def _(spark, sf):
    """A pattern bound to the end of a path must still remove everything below a matching directory."""
    near = within_bases(V.listing(spark, sf), bases(spark, sf))
    return prune_ignored(near, "/(tmp|de|es)$").select("base", "node")


@query("a9_tree_lines", f"WITH {V.FX_FILES}, {NODES}, {LINES} SELECT base, node, line FROM lines")
def _(spark, sf):
    return tree_lines(V.listing(spark, sf), bases(spark, sf)).select("base", "node", "line")


def _owners(spark, sf):
    joined = bases(spark, sf).join(V.roots(spark, sf), "session_id")
    return joined.select("base", display_path("base", "root", V.HOME, show_ellipsis=True).alias("display"))


@query("a9_tree_text", f"WITH {V.FX_FILES}, {NODES}, {LINES}, {TREES} SELECT base, {V.ONE_PART}, rendered FROM trees")
def _(spark, sf):
    lines = tree_lines(V.listing(spark, sf), bases(spark, sf))
    return tree_text(lines, _owners(spark, sf)).select("base", "part", "parts", "rendered")


@query("a9_tree_snapshot", f"""
WITH {V.FX_FILES}, {NODES}, {LINES}, {TREES}
SELECT CAST(0 AS BIGINT) AS part, base AS base_path, shown AS base_path_display, 'tmp' AS ignore_regex, sha256(rendered) AS rendered FROM trees""")
def _(spark, sf):
    lines = tree_lines(V.listing(spark, sf), bases(spark, sf))
    owners = _owners(spark, sf)
    snap = tree_snapshots(tree_text(lines, owners), owners, "tmp").select("part", "tree.*")
    return snap.withColumn("rendered", F.sha2("rendered", 256))
