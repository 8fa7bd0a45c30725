"""Queries: order, modes, joins on selections, common paths and roots, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from sheaf.constants import STALE_HEADLINES, STALE_TOOLTIP_HEAD
from sheaf.functions.paths import common_path, display_path
from sheaf.functions.text import is_text
from sheaf.operators.roots import common_paths, marker_dirs, project_roots
from sheaf.operators.selection import (
    apply_mode,
    dedupe_paths,
    existing,
    membership,
    resolve_basenames,
    selected_file_problem,
    selection_changed,
    with_order,
)
from sheaf.operators.stale import (
    current_hashes,
    explode_hashes,
    hash_maps,
    headlines,
    reports,
    snapshot,
    stale_files,
)
from sheaf.plans.packs import check_stale


@query("o1_path_order", f"""
WITH {V.FX_FILES} SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS ord
FROM fx_files""")
def _(spark, sf):
    return with_order(V.fx_files(spark, sf).select("session_id", "path"))


@query("o1_path_order_sliced", f"""
WITH {V.FX_FILES}, h AS (SELECT CASE WHEN n % 3 = 0 THEN 'hot' ELSE session_id END AS session_id, path FROM fx_files)
SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS ord FROM h""")
def _(spark, sf):
    """One session holds a third of all files and is cut into slices."""
    hot = F.expr("CAST(substr(session_id, 4) AS INT) % 3 = 0")
    files = V.fx_files(spark, sf).select(F.when(hot, F.lit("hot")).otherwise(F.col("session_id")).alias("session_id"), "path")
    return with_order(files, rows_per_slice=V.some_slices(files))


@query("u1_dedupe_paths", f"WITH {V.FX_FILES} SELECT DISTINCT session_id, path FROM fx_files")
def _(spark, sf):
    once = V.fx_files(spark, sf).select("session_id", "path")
    return dedupe_paths(once.unionByName(once.where(F.col("path").endswith(".md"))))


@query("s2_existing_selection", f"""
WITH {V.FX_FILES} SELECT session_id, path FROM fx_files WHERE doc_id % 8 <> 3""")
def _(spark, sf):
    files = V.fx_files(spark, sf)
    wanted = files.select("session_id", "path").unionByName(
        files.select("session_id", F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    )
    listed = V.listing(spark, sf).where(~F.col("path").endswith(".PY"))
    return existing(wanted, listed)


@query("f7_mode_files", f"""
WITH {V.FX_FILES}, {V.FILE_STATE} SELECT f.session_id, f.path FROM fx_files f JOIN file_state s USING (session_id)
WHERE is_text AND (s.selected_file IS NULL OR f.path = s.selected_file)""")
def _(spark, sf):
    files = V.fx_files(spark, sf).select("session_id", "path", is_text("content").alias("is_text"))
    return apply_mode(files, V.file_state(spark, sf)).select("session_id", "path")


@query("f7_mode_errors", f"""
WITH {V.FX_FILES}, {V.FILE_STATE} SELECT s.session_id, '# Error: Selected file '
  || regexp_extract(selected_file, '[^/]*$') || ' is ' || CASE WHEN f.path IS NULL THEN 'not found'
     ELSE 'not a text file' END || '.' AS message
FROM file_state s LEFT JOIN fx_files f ON f.session_id = s.session_id AND f.path = s.selected_file
WHERE s.selected_file IS NOT NULL AND NOT coalesce(f.is_text, false)""")
def _(spark, sf):
    files = V.fx_files(spark, sf).select("session_id", "path", is_text("content").alias("is_text"))
    return selected_file_problem(files, V.file_state(spark, sf))


@query("j3_basename_first", f"""
WITH {V.FX_PY}, p AS (SELECT session_id, '/z/' || CAST(doc_id % 5 AS VARCHAR) || '/' || lang || '.py' AS path, doc_id
  FROM fx_py), l AS (SELECT session_id, path, min(doc_id) AS ord FROM p GROUP BY ALL)
SELECT session_id, lang || '.py' AS name, arg_min(path, ord) AS path
FROM l JOIN (SELECT DISTINCT lang FROM documents) n ON path LIKE '%/' || lang || '.py' GROUP BY session_id, lang
UNION ALL
SELECT session_id, path, path FROM l WHERE path LIKE '/z/0/%'""")
def _(spark, sf):
    docs = V.documents(spark, sf)
    path = F.expr("'/z/' || CAST(doc_id % 5 AS STRING) || '/' || lang || '.py'")
    listed = docs.groupBy(F.col("source").alias("session_id"), path.alias("path")).agg(F.min("doc_id").alias("ord"))
    names = listed.select("session_id", F.substring_index("path", "/", -1).alias("name")).distinct()
    full = listed.where(F.col("path").startswith("/z/0/")).select("session_id", F.col("path").alias("name"))
    return resolve_basenames(names.unionByName(full), listed)


@query("j6_membership", f"""
WITH {V.FX_FILES} SELECT session_id, path, doc_id % 3 = 0 AS selected FROM fx_files""")
def _(spark, sf):
    docs = V.fx_files(spark, sf).select("session_id", "path")
    number = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("bigint")
    chosen = docs.where(number % 3 == 0).select("session_id", "path")
    return membership(docs, chosen)


@query("u3_selection_changed", """
SELECT doc_id, doc_id % 4 <> 0 AND (doc_id % 4 <> 1 OR lang <> 'en') AS changed FROM documents""")
def _(spark, sf):
    rows = V.documents(spark, sf).selectExpr(
        "doc_id",
        "array('a', 'b', lang) AS old_items",
        "CASE WHEN doc_id % 4 = 1 THEN array('b', 'a', 'en') WHEN doc_id % 4 = 2 THEN array('a') "
        "ELSE array(lang, 'b', 'a', 'a') END AS new_items",
        "'All Files' AS old_mode",
        "'All Files' AS new_mode",
        "CAST(NULL AS STRING) AS old_file",
        "CASE WHEN doc_id % 4 = 3 THEN 'x.py' END AS new_file",
    )
    changed = selection_changed("old_items", "new_items", "old_mode", "new_mode", "old_file", "new_file")
    return rows.select("doc_id", changed.alias("changed"))


_LEVELS = """lv AS (SELECT session_id || CASE WHEN n % 4 = 0 AND doc_id % 11 <= 2 THEN '-rest' ELSE '' END AS session_id,
    string_split(path, '/') AS p FROM fx_files
  UNION ALL SELECT session_id || '-one', string_split(min(path), '/') FROM fx_files WHERE n % 4 = 1 GROUP BY session_id),
k AS (SELECT session_id, unnest(range(1, 9)) AS i, p FROM lv),
agree AS (SELECT session_id, i, count(DISTINCT coalesce(p[i], '')) = 1 AND bool_and(len(p) >= i) AS same, min(p[i]) AS part
  FROM k GROUP BY session_id, i),
cut AS (SELECT session_id, coalesce(min(i) FILTER (WHERE NOT same), 99) AS stop FROM agree GROUP BY session_id),
common AS (SELECT a.session_id, string_agg(part, '/' ORDER BY i) AS common FROM agree a JOIN cut c USING (session_id)
  WHERE i < stop GROUP BY a.session_id)"""


def _split_sessions(spark, sf):
    """All files; some sessions are split in two, and some have a further session of one file."""
    number = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("bigint")
    kind = F.expr("CAST(substr(session_id, 4) AS INT) % 4")
    files = V.fx_files(spark, sf)
    rest = F.when((kind == 0) & (number % 11 <= 2), F.lit("-rest")).otherwise(F.lit(""))
    split = files.select(F.concat("session_id", rest).alias("session_id"), "path")
    one = files.where(kind == 1).groupBy("session_id").agg(F.min("path").alias("path"))
    return split.unionByName(one.withColumn("session_id", F.concat("session_id", F.lit("-one"))))


@query("a1_common_path", f"WITH {V.FX_FILES}, {_LEVELS} SELECT session_id, common FROM common")
def _(spark, sf):
    return common_paths(_split_sessions(spark, sf))


@query("j4_project_root", f"""
WITH {V.FX_FILES}, {_LEVELS} SELECT session_id, common,
  CASE WHEN CAST(regexp_extract(session_id, '[0-9]+') AS INT) % 2 = 0 THEN '/home/u/code/' || regexp_extract(session_id, 'src[0-9]+')
    ELSE common END AS root
FROM common""")
def _(spark, sf):
    return project_roots(_split_sessions(spark, sf), marker_dirs(V.listing(spark, sf)), V.HOME)


@query("a1_lang_common_path", f"""
WITH {V.FX_FILES} SELECT lang, '/home/u/code' AS common FROM fx_files GROUP BY lang""")
def _(spark, sf):
    lang = F.element_at(F.split("path", "/"), -2).alias("lang")
    return V.fx_files(spark, sf).groupBy(lang).agg(common_path("path").alias("common"))


@query("a5_hash_map", f"""
WITH {V.FX_FILES} SELECT session_id, path, sha256(content) AS hash FROM fx_files WHERE is_text""")
def _(spark, sf):
    maps = hash_maps(snapshot(V.fx_files(spark, sf)), ["session_id"], shard_rows=16)
    return explode_hashes(maps, ["session_id"])


@query("j1_stale", f"WITH {V.STALE} SELECT session_id, path, status FROM stale")
def _(spark, sf):
    return stale_files(V.snapshots(spark, sf), current_hashes(V.files_now(spark, sf)))


@query("j1_stale_strict", """
WITH cut AS (SELECT *, octet_length(encode(text)) <= 1024
    OR substr(hex(encode(text)), 2049, 1) NOT IN ('8', '9', 'A', 'B') AS is_text FROM documents)
SELECT source AS session_id, 'p' || CAST(doc_id AS VARCHAR) AS path, 'modified' AS status
FROM cut WHERE is_text AND doc_id % 9 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 = 0""")
def _(spark, sf):
    current = current_hashes(V.files_now(spark, sf), reference_strict=True)
    return stale_files(V.snapshots(spark, sf), current, reference_strict=True)


@query("j1_stale_shared_paths", """
WITH p AS (SELECT DISTINCT source AS session_id, CASE WHEN doc_id % 3 = 0 THEN 'p0' ELSE 'p' || CAST(doc_id % 50 AS VARCHAR) END AS path,
  doc_id % 9 <> 0 AND doc_id % 17 <> 0 AS there FROM documents),
now AS (SELECT DISTINCT path FROM p WHERE there)
SELECT DISTINCT session_id, path, CASE WHEN path IN (SELECT path FROM now) THEN 'modified' ELSE 'missing' END AS status FROM p""")
def _(spark, sf):
    """Sessions that list the same paths, one path in a third of all rows: one row per session and path."""
    return stale_files(V.shared_paths(spark, sf, "snapshots"), current_hashes(V.shared_paths(spark, sf, "now")))


_HEAD = f"""CASE max(CASE status WHEN 'missing' THEN 3 WHEN 'error' THEN 2 ELSE 1 END) WHEN 3 THEN '{STALE_HEADLINES["missing"]}'
  WHEN 2 THEN '{STALE_HEADLINES["error"]}' ELSE '{STALE_HEADLINES["modified"]}' END"""


@query("a6_stale_headline", f"""
WITH {V.STALE}, g AS (SELECT *, session_id || ':' || right(path, 1) AS state_id FROM stale)
SELECT session_id, state_id, {_HEAD} AS headline, count(*) AS files FROM g GROUP BY session_id, state_id""")
def _(spark, sf):
    state = F.concat("session_id", F.lit(":"), F.right("path", F.lit(1)))
    stored = V.snapshots(spark, sf).withColumn("state_id", state)
    stale = stale_files(stored, current_hashes(V.files_now(spark, sf)))
    return headlines(stale, ["session_id", "state_id"]).select("session_id", "state_id", "headline", "files")


@query("a6_stale_report", f"""
WITH {V.STALE} SELECT session_id, {V.ONE_PART}, '{STALE_TOOLTIP_HEAD}' ||
  string_agg(chr(10) || '- ' || path || ' (' || status || ')', '' ORDER BY path) AS report
FROM stale GROUP BY session_id""")
def _(spark, sf):
    stale = stale_files(V.snapshots(spark, sf), current_hashes(V.files_now(spark, sf)))
    return reports(stale, ["session_id"]).select("session_id", "part", "parts", "report")


@query("o5_sorted_report_parts", f"""
WITH {V.STALE}, l AS (SELECT session_id, path, chr(10) || '- ~' || path || ' (' || status || ')' AS line FROM stale
  UNION ALL SELECT DISTINCT session_id, '', '{STALE_TOOLTIP_HEAD}' FROM stale),
w AS (SELECT *, octet_length(encode(line)) AS size FROM l),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY session_id ORDER BY path
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT session_id, CAST(before // 100 AS BIGINT) AS part, string_agg(line, '' ORDER BY path) AS report
FROM b GROUP BY ALL""")
def _(spark, sf):
    stale = stale_files(V.snapshots(spark, sf), current_hashes(V.files_now(spark, sf)))
    shown = stale.withColumn("shown", F.concat(F.lit("~"), "path"))
    return reports(shown, ["session_id"], "shown", part_bytes=100).select("session_id", "part", "report")


@query("c6_check_stale", f"""
WITH {V.STALE} SELECT session_id, {_HEAD} AS headline, count(*) AS files FROM stale GROUP BY session_id""")
def _(spark, sf):
    return check_stale(V.snapshots(spark, sf), V.files_now(spark, sf), ["session_id"]).select(
        "session_id", "headline", "files"
    )


@query("c6_check_stale_digest", f"""
WITH s AS (SELECT source AS session_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'modified' END AS status
  FROM documents WHERE doc_id % 13 < 3 AND (doc_id % 9 = 0 OR doc_id % 17 = 0 OR doc_id % 7 = 0))
SELECT session_id, {_HEAD} AS headline, count(*) AS files FROM s GROUP BY session_id""")
def _(spark, sf):
    """Folders compared by digests from the top down; files only in the three of thirteen folders that differ."""
    docs = V.documents(spark, sf).selectExpr("*", "'/d/' || source || '/' || CAST(doc_id % 13 AS STRING) || '/p' || CAST(doc_id AS STRING) AS path")
    stored = docs.select(F.col("source").alias("session_id"), "path", F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 13 >= 3 OR doc_id % 9 <> 0").selectExpr(
        "path",
        "CASE WHEN doc_id % 13 < 3 AND doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 < 3 AND doc_id % 7 = 0 THEN encode(text || '!', 'UTF-8') ELSE encode(text, 'UTF-8') END AS content",
        "CASE WHEN doc_id % 13 < 3 AND doc_id % 17 = 0 THEN 'error' END AS error",
    )
    return check_stale(stored, now, ["session_id"], by_digests=True).select("session_id", "headline", "files")


@query("j1_fresh_snapshot_is_empty", "SELECT source AS session_id, source AS path, '' AS status FROM documents WHERE false")
def _(spark, sf):
    """A snapshot compared with the very files it was made from reports nothing."""
    files = V.fx_files(spark, sf)
    return stale_files(snapshot(files), current_hashes(files))


@query("p3_display_of_roots", """
SELECT source AS session_id, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 1 THEN '~/code/' || source
  WHEN 3 THEN '~/code/' || source ELSE '~/code/' || source || '/' END AS shown FROM documents GROUP BY source""")
def _(spark, sf):
    base = F.concat(F.lit("/home/u/code/"), "session_id")
    return V.roots(spark, sf).select(
        "session_id", display_path(base, "root", V.HOME, show_ellipsis=True).alias("shown")
    )
