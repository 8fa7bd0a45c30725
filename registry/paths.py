"""Queries: predicates, paths, text and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from sheaf.constants import EXTENSION_GROUPS, IGNORE_DEFAULT
from sheaf.functions.paths import basename, display_path, language, parent
from sheaf.functions.patterns import display_pattern, normalize_pattern
from sheaf.functions.text import content_hash, decode_text, head, is_text, non_blank_lines
from sheaf.functions.times import iso_timestamp, modified_line
from sheaf.operators.filters import drop_hidden, drop_ignored, drop_ignored_by_session, in_group, keep_python
from sheaf.operators.render import full_block, metadata


@query("f1_ignore", f"WITH {V.FX_FILES} SELECT session_id, path FROM fx_files WHERE {V.NOT_IGNORED}")
def _(spark, sf):
    return drop_ignored(V.fx_files(spark, sf)).select("session_id", "path")


_OWN = r"""CASE CAST(substr(session_id, 4) AS INT) % 5 WHEN 1 THEN 'legit' || chr(10) || ' [.]json$' WHEN 2 THEN '('
  WHEN 3 THEN 'doc_{digit}+5[.]' WHEN 4 THEN '/en/' END"""


@query("f1_session_patterns", f"""
WITH {V.FX_FILES} SELECT session_id, path FROM fx_files WHERE CASE n % 5 WHEN 0 THEN {V.NOT_IGNORED}
  WHEN 1 THEN NOT regexp_matches(path, 'legit|[.]json$') WHEN 2 THEN true WHEN 3 THEN NOT regexp_matches(path, 'doc_[0-9]+5[.]')
  ELSE NOT regexp_matches(path, '/en/') END""")
def _(spark, sf):
    """Each session has its own pattern: none, two lines, an invalid one, one for Python's engine, a plain one."""
    files = V.fx_files(spark, sf)
    settings = files.select("session_id").distinct().selectExpr("session_id", _OWN.format(digit=r"\\d") + " AS ignore")
    return drop_ignored_by_session(files, settings).select("session_id", "path")


@query("s1_hidden_prune", f"WITH {V.FX_FILES} SELECT session_id, path FROM fx_files WHERE doc_id % 11 <> 2")
def _(spark, sf):
    return drop_hidden(V.fx_files(spark, sf), V.CODE).select("session_id", "path")


@query("f2_normalize_pattern", """
SELECT doc_id, lang || '|' || source || '|(a|b)' AS stored,
  lang || chr(10) || source || chr(10) || '(a' || chr(10) || 'b)' AS shown FROM documents""")
def _(spark, sf):
    raw = F.concat(F.lit("  "), "lang", F.lit("\n\n \t\n"), "source", F.lit(" \r\n(a|b)\n"))
    stored = V.documents(spark, sf).select("doc_id", normalize_pattern(raw).alias("stored"))
    return stored.select("doc_id", "stored", display_pattern("stored").alias("shown"))


@query("f3_pattern_fallback", f"""
WITH {V.FX_FILES} SELECT session_id, count(*) AS all_files, count(*) AS kept_invalid,
  count(*) FILTER (WHERE {V.NOT_IGNORED}) AS kept_blank, count(*) FILTER (WHERE {V.NOT_IGNORED}) AS kept_default
FROM fx_files GROUP BY session_id""")
def _(spark, sf):
    from sheaf.functions.patterns import effective_pattern

    def kept(raw):
        pattern = effective_pattern(spark, raw)
        return F.count_if(F.lit(True) if pattern is None else ~F.col("path").rlike(pattern))

    return V.fx_files(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("all_files"),
        kept("(").alias("kept_invalid"),
        kept("  \n ").alias("kept_blank"),
        kept(None).alias("kept_default"),
    )


@query("f4_text_check", f"WITH {V.FX_FILES} SELECT path, is_text FROM fx_files")
def _(spark, sf):
    return V.fx_files(spark, sf).select("path", is_text("content").alias("is_text"))


@query("f4_text_check_strict", f"WITH {V.FX_FILES} SELECT path, is_text_strict AS is_text FROM fx_files")
def _(spark, sf):
    """The byte-exact rule: a character that the cut divides makes the file binary."""
    return V.fx_files(spark, sf).select("path", is_text("content", reference_strict=True).alias("is_text"))


@query("f5_extension_groups", f"""
WITH {V.FX_FILES}, groups(name, exts) AS (VALUES ('All', NULL), ('Python', ['py']), ('JavaScript', ['js']),
  ('TypeScript', ['ts', 'tsx']), ('Text', ['txt', 'md']), ('Configuration', ['json', 'yaml', 'yml', 'toml', 'ini'])),
named AS (SELECT path, regexp_extract(path, '[.]([^./]*)$', 1) AS ext FROM fx_files
  UNION ALL SELECT '/home/u/code/' || source || '/src/doc_' || CAST(doc_id AS VARCHAR) || '.py', 'py' FROM documents)
SELECT g.name AS file_group, f.path FROM named f JOIN groups g ON g.exts IS NULL OR list_contains(g.exts, f.ext)""")
def _(spark, sf):
    files = V.fx_files(spark, sf).select("path").unionByName(V.fx_py(spark, sf).select("path"))
    names = ["All", *EXTENSION_GROUPS]
    marks = F.array(*[F.when(in_group(n), F.lit(n)) for n in names])
    return files.select(F.explode(F.array_compact(marks)).alias("file_group"), "path")


@query("f6_python_sources", f"WITH {V.FX_PY} SELECT session_id, path FROM fx_py")
def _(spark, sf):
    files = V.fx_files(spark, sf).unionByName(V.fx_py(spark, sf))
    return keep_python(files).select("session_id", "path")


@query("o4_head_bytes", f"""
WITH {V.FX_FILES} SELECT path, CAST(least(octet_length(content), 1024) AS BIGINT) AS head_bytes,
  lower(substr(hex(content), 1, 2048)) AS head_hex FROM fx_files""")
def _(spark, sf):
    first = head("content")
    return V.fx_files(spark, sf).select(
        "path", F.octet_length(first).cast("bigint").alias("head_bytes"), F.lower(F.hex(first)).alias("head_hex")
    )


@query("p1_decode", f"""
WITH {V.FX_FILES}, d AS (SELECT path, CASE WHEN doc_id % 8 = 4 AND regexp_full_match(raw, '[\\x00-\\x7F]*')
  THEN raw || chr(233) ELSE text END AS t FROM fx_files)
SELECT path, sha256(t) AS text_hash, CAST(length(t) AS BIGINT) AS chars FROM d""")
def _(spark, sf):
    # some pure-ASCII files end in a lone Latin-1 byte, which is not UTF-8
    ascii_html = F.col("path").endswith(".html") & (F.octet_length("content") == F.length(F.col("content").cast("string")))
    content = F.when(ascii_html, F.concat("content", F.lit(bytearray(b"\xe9")))).otherwise(F.col("content"))
    text = V.fx_files(spark, sf).select("path", decode_text(content).alias("t"))
    return text.select("path", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("bigint").alias("chars"))


@query("p2_language", f"WITH {V.FX_FILES} SELECT path, language FROM fx_files")
def _(spark, sf):
    return V.fx_files(spark, sf).select("path", language("path").alias("language"))


@query("p3_display_path", f"""
WITH {V.FX_FILES} SELECT session_id, path, {V.display(False)} AS shown, {V.display(True)} AS shown_short
FROM fx_files""")
def _(spark, sf):
    joined = V.fx_files(spark, sf).select("session_id", "path").join(V.roots(spark, sf), "session_id")
    return joined.select(
        "session_id",
        "path",
        display_path("path", "root", V.HOME).alias("shown"),
        display_path("path", "root", V.HOME, show_ellipsis=True).alias("shown_short"),
    )


@query("p4_content_hash", f"WITH {V.FX_FILES} SELECT path, sha256(content) AS file_hash FROM fx_files")
def _(spark, sf):
    return V.fx_files(spark, sf).select("path", content_hash("content").alias("file_hash"))


@query("p5_modified_line", f"""
WITH {V.FX_FILES} SELECT path, {V.LABEL} AS shown,
  '**Last modified: ' || strftime(mtime, '%Y-%m-%dT%H:%M:%S+00:00') || '**' AS machine FROM fx_files""")
def _(spark, sf):
    return V.fx_files(spark, sf).select(
        "path", modified_line("mtime").alias("shown"), modified_line("mtime", machine_readable=True).alias("machine")
    )


@query("p5_event_iso_times", r"""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events""")
def _(spark, sf):
    from registry.core import table

    return table(spark, sf, "events").select("event_id", iso_timestamp(F.col("ts").cast("timestamp")).alias("iso"))


_BREAKS = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'"


@query("p6_line_count", f"""
WITH {V.FX_FILES} SELECT path, CAST(len(list_filter(string_split_regex(text, {_BREAKS}),
  lambda l: regexp_matches(l, '[^\\s]'))) AS BIGINT) AS line_count FROM fx_files""")
def _(spark, sf):
    return V.fx_files(spark, sf).select("path", non_blank_lines(decode_text("content")).alias("line_count"))


@query("p7_file_block", f"WITH {V.FX_FILES} SELECT path, {V.block(V.display(True))} AS block FROM fx_files WHERE is_text")
def _(spark, sf):
    joined = V.fx_files(spark, sf).where(is_text("content")).join(V.roots(spark, sf), "session_id")
    shown = display_path("path", "root", V.HOME, show_ellipsis=True)
    return joined.select(
        "path", full_block(shown, modified_line("mtime"), language("path"), decode_text("content")).alias("block")
    )


@query("p8_settings", f"""
SELECT source AS session_id, CASE n % 3 WHEN 0 THEN '*.log' WHEN 1 THEN 'shared' ELSE '{IGNORE_DEFAULT}' END AS ignore_pattern,
  CASE WHEN n % 2 = 0 THEN '/home/u/code' ELSE '/home/u/code/' || source END AS folder,
  CASE n % 5 WHEN 0 THEN '/w/' || source WHEN 1 THEN '/r/' || source WHEN 2 THEN '/r/' || source
             WHEN 3 THEN '/d' ELSE '/home/u/code/' || source END AS tree_base,
  CASE n % 5 WHEN 0 THEN '/w/' || source WHEN 1 THEN '/r/' || source WHEN 2 THEN '/r/' || source END AS root
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents)""")
def _(spark, sf):
    from sheaf.operators.roots import effective_root, folder_base, ignore_setting, tree_base

    settings = V.documents(spark, sf).select("source").distinct().selectExpr(
        "source AS session_id",
        "CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN ' /w/' || source || ' ' WHEN 1 THEN '  ' END AS window_base",
        "CASE CAST(substr(source, 4) AS INT) % 5 WHEN 1 THEN '/r/' || source WHEN 2 THEN '/r/' || source END AS found",
        "CASE CAST(substr(source, 4) AS INT) % 5 WHEN 3 THEN '/d' ELSE '' END AS default_base",
        "'/home/u/code/' || source AS common",
        "CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN '*.log' ELSE ' ' END AS window_ignore",
        "CASE WHEN CAST(substr(source, 4) AS INT) % 3 < 2 THEN 'shared' END AS shared_ignore",
        "CAST(substr(source, 4) AS INT) % 2 = 0 AS is_file",
    )
    return settings.select(
        "session_id",
        tree_base("window_base", "found", "default_base", "common").alias("tree_base"),
        effective_root("window_base", "found").alias("root"),
        ignore_setting("window_ignore", "shared_ignore").alias("ignore_pattern"),
        folder_base("common", "is_file").alias("folder"),
    )


@query("p9_metadata", f"""
WITH {V.FX_FILES} SELECT session_id, path, {V.display(False)} AS display_path, is_text AS is_text_file, language,
  strftime(mtime, '%Y-%m-%dT%H:%M:%S+00:00') AS last_modified, sha256(content) AS file_hash,
  CAST(octet_length(content) AS BIGINT) AS size_bytes FROM fx_files""")
def _(spark, sf):
    joined = V.fx_files(spark, sf).join(V.roots(spark, sf), "session_id")
    return metadata(joined, V.HOME).withColumn("last_modified", iso_timestamp("last_modified"))


@query("p10_names", f"""
WITH {V.FX_FILES} SELECT path, regexp_extract(path, '[^/]*$') AS name,
  regexp_replace(path, '/[^/]*$', '') AS parent FROM fx_files""")
def _(spark, sf):
    return V.fx_files(spark, sf).select("path", basename("path").alias("name"), parent("path").alias("parent"))
