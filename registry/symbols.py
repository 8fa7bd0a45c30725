"""Queries: Python symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from sheaf.functions.text import decode_text, is_text
from sheaf.operators import symbols as S
from sheaf.operators.render import blocks
from sheaf.operators.selection import apply_mode, path_set
from sheaf.plans.packs import decisions, python_symbols

NAMES_ONLY = "array<string>"


def _sources(spark, sf):
    files = V.fx_py(spark, sf)
    return files.withColumns({"text": decode_text("content"), "is_text": is_text("content")})


def _parsed(spark, sf, code=False):
    return S.with_source(_sources(spark, sf), None if code else F.array().cast(NAMES_ONLY))


_SYMBOLS = """symbols AS (SELECT session_id, n, path, 0 AS ord, 'class' AS kind, cls AS name, cls_code AS code
  FROM fx_py WHERE parses
  UNION ALL SELECT session_id, n, path, 1, 'function', fn, fn_code FROM fx_py WHERE parses)"""


@query("x1_symbols", f"WITH {V.FX_PY}, {_SYMBOLS} SELECT session_id, path, ord, kind, name, code FROM symbols")
def _(spark, sf):
    return S.symbols(_parsed(spark, sf, code=True), ["session_id", "path"])


@query("x1_symbol_names", f"WITH {V.FX_PY}, {_SYMBOLS} SELECT session_id, path, ord, kind, name FROM symbols")
def _(spark, sf):
    return S.symbols(_parsed(spark, sf), ["session_id", "path"]).drop("code")


_STMTS = """stmts AS (SELECT session_id, path, 'import os' AS stmt FROM fx_py WHERE parses
  UNION ALL SELECT session_id, path, from_import FROM fx_py WHERE parses)"""


@query("x2_imports", f"WITH {V.FX_PY}, {_STMTS} SELECT * FROM stmts")
def _(spark, sf):
    return S.imports(_parsed(spark, sf), ["session_id", "path"])


@query("x2_import_names", f"""
WITH {V.FX_PY} SELECT path, 'os' AS alias, 'os' AS origin FROM fx_py WHERE parses
UNION ALL SELECT path, lang || '_x', source || '.' || lang || '_x' FROM fx_py WHERE parses""")
def _(spark, sf):
    return S.import_names(_parsed(spark, sf), ["path"])


@query("a4_session_imports", f"WITH {V.FX_PY}, {_STMTS} SELECT DISTINCT session_id, stmt FROM stmts")
def _(spark, sf):
    return S.session_imports(_parsed(spark, sf))


@query("a4_file_imports", f"""
WITH {V.FX_PY} SELECT path, from_import || chr(10) || 'import os' AS imports FROM fx_py WHERE parses""")
def _(spark, sf):
    parsed = _parsed(spark, sf).where(F.col("source.error").isNull())
    return parsed.select("path", F.array_join("source.imports", "\n").alias("imports"))


@query("u4_import_union", f"""
WITH {V.FX_PY} SELECT path, from_import || '|import json|import os' AS stmts FROM fx_py WHERE parses""")
def _(spark, sf):
    parsed = _parsed(spark, sf).where(F.col("source.error").isNull())
    rows = parsed.select("path", F.col("source.imports").alias("a"), F.expr("array('import os', 'import json')").alias("b"))
    return rows.select("path", F.array_join(path_set("a", "b"), "|").alias("stmts"))


@query("a3_symbol_lists", f"""
WITH {V.FX_PY} SELECT session_id, path, cls AS classes, fn AS functions FROM fx_py WHERE parses""")
def _(spark, sf):
    lists = S.symbol_lists(_parsed(spark, sf), ["session_id", "path"])
    return lists.select(
        "session_id", "path", F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions")
    )


@query("a3_symbol_response", f"""
WITH {V.FX_PY} SELECT session_id, path, '{{"classes":["' || cls || '"],"functions":["' || fn || '"]}}' AS names
FROM fx_py WHERE parses""")
def _(spark, sf):
    """The response maps, in shards, opened up again."""
    shards = S.symbol_response(_parsed(spark, sf), shard_rows=16)
    rows = shards.select("session_id", F.explode("symbols").alias("path", "names"))
    return rows.select("session_id", "path", F.to_json("names").alias("names"))


@query("u2_names_of_any_kind", f"WITH {V.FX_PY}, {_SYMBOLS} SELECT DISTINCT session_id, name FROM symbols")
def _(spark, sf):
    return S.symbols(_parsed(spark, sf), ["session_id"]).select("session_id", "name").distinct()


@query("a7_parse_errors", f"""
WITH {V.FX_PY} SELECT session_id, path, 'doc_' || CAST(doc_id AS VARCHAR) || '.py: Syntax error in doc_'
  || CAST(doc_id AS VARCHAR) || '.py: line 1 - invalid syntax' AS message FROM fx_py WHERE NOT parses""")
def _(spark, sf):
    return S.parse_errors(_parsed(spark, sf), ["session_id", "path"])


@query("a8_session_flags", f"""
WITH {V.FX_PY} SELECT session_id, true AS has_python_text_files, bool_or(parses) AS found_symbols,
  bool_or(NOT parses) AS has_errors FROM fx_py GROUP BY session_id""")
def _(spark, sf):
    return S.session_flags(_parsed(spark, sf))


_CHOSEN = f"""WITH {V.FX_PY}, {V.PY_STATE}, {_SYMBOLS},
picked AS (SELECT y.*, s.path, s.ord, s.kind, s.name, s.code FROM symbols s JOIN py_state y USING (session_id)
  WHERE y.has_items AND (s.name = 'load_en' OR s.name = y.wanted_cls)
    AND (y.mode = 'All Files' OR s.path = y.selected_file)),
decided AS (SELECT f.*, CASE WHEN NOT f.parses THEN 'error' WHEN NOT y.has_items THEN 'full'
    WHEN f.path IN (SELECT path FROM picked) THEN 'filtered' WHEN y.mode = 'Single File' THEN 'none' ELSE 'full' END
    AS decision
  FROM fx_py f JOIN py_state y USING (session_id) WHERE y.mode = 'All Files' OR f.path = y.selected_file)"""


@query("j2_selected_symbols", f"{_CHOSEN} SELECT session_id, path, kind, name FROM picked")
def _(spark, sf):
    chosen = apply_mode(_sources(spark, sf), V.py_state(spark, sf))
    parsed = S.with_source(chosen, F.array().cast(NAMES_ONLY))
    return parsed.select("session_id", "path", F.explode(S.matched_symbols()).alias("s")).select(
        "session_id", "path", "s.kind", "s.name"
    )


@query("f8_filter_decision", f"{_CHOSEN} SELECT session_id, path, decision FROM decided")
def _(spark, sf):
    return decisions(_sources(spark, sf), V.py_state(spark, sf))


PY_LABEL = "'**Last modified: ' || strftime(mtime, '%b %d, %Y %I:%M %p') || ' UTC**'"
PY_BLOCK = f"""CASE decision WHEN 'full' THEN '# ~/' || substr(path, 9) || chr(10) || {PY_LABEL} || chr(10) || chr(10)
    || '```python' || chr(10) || {V.stripped('text')} || chr(10) || '```' || chr(10) || chr(10)
  WHEN 'filtered' THEN '# Code from: ~/' || substr(path, 9) || chr(10) || {PY_LABEL} || chr(10) || chr(10)
    || '# Imports (potentially includes more than needed):' || chr(10) || from_import || chr(10) || 'import os'
    || chr(10) || chr(10) || '# Selected Classes/Functions:' || chr(10)
    || (SELECT string_agg(p.code, chr(10) || chr(10) ORDER BY p.ord) FROM picked p WHERE p.path = decided.path)
    || chr(10) || chr(10) || chr(10) END"""


@query("x3_code_blocks", f"{_CHOSEN} SELECT session_id, path, {PY_BLOCK} AS block FROM decided WHERE decision = 'filtered'")
def _(spark, sf):
    chosen = apply_mode(_sources(spark, sf), V.py_state(spark, sf))
    parsed = S.with_source(chosen, "selected_items").withColumn("root", F.lit(None).cast("string"))
    return blocks(parsed, V.HOME).where("decision = 'filtered'").select("session_id", "path", "block")


@query("c2_python_symbols", f"""
WITH {V.FX_PY} SELECT session_id, path, CASE WHEN parses THEN cls END AS classes,
  CASE WHEN parses THEN fn END AS functions, CASE WHEN NOT parses THEN 'doc_' || CAST(doc_id AS VARCHAR)
  || '.py: Syntax error in doc_' || CAST(doc_id AS VARCHAR) || '.py: line 1 - invalid syntax' END AS error FROM fx_py""")
def _(spark, sf):
    found = python_symbols(V.fx_py(spark, sf).unionByName(V.fx_files(spark, sf)))
    return found.select(
        "session_id", "path", F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"), "error"
    )
