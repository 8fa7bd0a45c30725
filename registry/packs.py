"""Queries: packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from registry.symbols import _CHOSEN, PY_BLOCK
from registry.trees import LINES, NODES, TREES, bases
from sheaf.constants import NO_TEXT_FILES, PART_BYTES
from sheaf.plans.packs import PackOptions, pack_errors, process_files, update_selection

NO_STATE = "session_id string, mode string, selected_file string, selected_items array<string>"


def _no_state(spark):
    return spark.createDataFrame([], NO_STATE)


_KEPT = f"kept AS (SELECT * FROM fx_files WHERE {V.NOT_IGNORED})"
_BLOCKS = f"""blocks AS (SELECT session_id, path, {V.block(V.display(True))} AS block,
  octet_length(content) AS size FROM kept WHERE is_text)"""
_LINE_COUNT = "CAST(len(list_filter(string_split(output_text, chr(10)), lambda l: regexp_matches(l, '[^\\s]'))) AS BIGINT)"



def packs_in_parts(rows: str, part_bytes: int) -> str:
    """SQL of the packs of ``rows`` (session_id, path, size, block) in parts numbered without gaps."""
    return f"""w AS (SELECT *, coalesce(sum(2 * size + octet_length(encode(path)) + 256) OVER (PARTITION BY session_id
    ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {part_bytes} AS step FROM {rows}),
n AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY step) - 1 AS part FROM w),
g AS (SELECT session_id, part, string_agg(block, '' ORDER BY path) AS t FROM n GROUP BY ALL),
packs AS (SELECT session_id, part, max(part) OVER (PARTITION BY session_id) + 1 AS parts,
  CASE WHEN part = max(part) OVER (PARTITION BY session_id) THEN rtrim(t, chr(10)) ELSE t END AS output_text FROM g)"""


A2 = f"""WITH {V.FX_FILES}, {_KEPT}, {_BLOCKS}, {packs_in_parts("blocks", PART_BYTES)}
SELECT session_id, part, parts, output_text, {_LINE_COUNT} AS line_count FROM packs"""


def all_files_pack(spark, sf):
    packs = process_files(V.fx_files(spark, sf), V.roots(spark, sf), _no_state(spark), PackOptions(home=V.HOME))
    return packs.select("session_id", "part", "parts", "output_text", "line_count")


@query("a2_pack", A2)
def _(spark, sf):
    return all_files_pack(spark, sf)


@query("a2_pack_parts", f"""
WITH {V.FX_FILES}, {_KEPT}, {_BLOCKS}, {packs_in_parts("blocks", 10_000)} SELECT * FROM packs""")
def _(spark, sf):
    """The same packs in parts of about 10 kB: the plan for sessions too big for one row."""
    options = PackOptions(home=V.HOME, part_bytes=10_000)
    packs = process_files(V.fx_files(spark, sf), V.roots(spark, sf), _no_state(spark), options)
    return packs.select("session_id", "part", "parts", "output_text")


@query("a2_pack_hot_session", f"""
WITH {V.FX_FILES}, {_KEPT}, b AS (SELECT CASE WHEN n % 3 = 0 THEN 'hot' ELSE session_id END AS session_id, path,
    octet_length(content) AS size, {V.block("'~/' || substr(path, 9)")} AS block FROM kept WHERE is_text),
{packs_in_parts("b", 50_000)} SELECT * FROM packs""")
def _(spark, sf):
    """One session holds a third of all files: sliced numbering, many parts."""
    hot = F.expr("CAST(substr(session_id, 4) AS INT) % 3 = 0")
    session = F.when(hot, F.lit("hot")).otherwise(F.col("session_id"))
    files = V.fx_files(spark, sf).withColumn("session_id", session)
    roots = files.select("session_id", F.lit(None).cast("string").alias("root")).distinct()
    options = PackOptions(home=V.HOME, part_bytes=50_000, rows_per_slice=V.some_slices(files))
    packs = process_files(files, roots, _no_state(spark), options)
    return packs.select("session_id", "part", "parts", "output_text")


_TINY = """CASE WHEN doc_id % 3 = 0 THEN encode('') ELSE content END"""


@query("a2_pack_tiny_files", f"""
WITH {V.FX_FILES}, {_KEPT}, b AS (SELECT session_id, path, octet_length(content) AS size, {V.block(V.display(True))} AS block
  FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text, {_TINY} AS content) FROM kept) WHERE is_text OR doc_id % 3 = 0),
{packs_in_parts("b", 5_000)} SELECT * FROM packs""")
def _(spark, sf):
    """A third of the files are empty: headings weigh too."""
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    files = V.fx_files(spark, sf).withColumn("content", F.when(number % 3 == 0, F.lit(bytearray())).otherwise(F.col("content")))
    packs = process_files(files, V.roots(spark, sf), _no_state(spark), PackOptions(home=V.HOME, part_bytes=5_000))
    return packs.select("session_id", "part", "parts", "output_text")


@query("a2_pack_big_file", f"""
WITH {V.FX_FILES}, {_KEPT}, {_BLOCKS}, {packs_in_parts("blocks", 1_000)} SELECT * FROM packs""")
def _(spark, sf):
    """Nearly every file outgrows a part: it stands alone, and no number is left out."""
    options = PackOptions(home=V.HOME, part_bytes=1_000)
    packs = process_files(V.fx_files(spark, sf), V.roots(spark, sf), _no_state(spark), options)
    return packs.select("session_id", "part", "parts", "output_text")


@query("a2_pack_unparsable", f"""
WITH {V.FX_PY}, b AS (SELECT session_id, path, octet_length(encode(text)) AS size, CASE WHEN doc_id % 5 < 2 AND n % 2 = 0 THEN '# ' || {V.display(True)} || chr(10) || {V.LABEL} || chr(10) || chr(10)
    || '```python' || chr(10) || {V.stripped("text")} || chr(10) || '```' || chr(10) || chr(10) END AS block
  FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 < 2 AND n % 2 = 0 THEN 'x = ' || chr(39) || repeat('a', doc_id % 50) || chr(39) ELSE 'def :' END AS text) FROM fx_py)),
w AS (SELECT *, coalesce(sum(2 * size + octet_length(encode(path)) + 256) OVER (PARTITION BY session_id
    ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 700 AS step FROM b),
d AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY step) - 1 AS k FROM w),
l AS (SELECT session_id, coalesce(max(k) FILTER (WHERE block IS NOT NULL), 0) AS last FROM d GROUP BY session_id),
g AS (SELECT session_id, least(k, last) AS part, last, coalesce(string_agg(block, '' ORDER BY path), '') AS t FROM d JOIN l USING (session_id) GROUP BY ALL)
SELECT session_id, part, last + 1 AS parts, CASE WHEN part = last THEN rtrim(t, chr(10)) ELSE t END AS output_text FROM g""")
def _(spark, sf):
    """Most sources do not parse; parts at a session's end that show nothing are merged, however many there are."""
    files = V.fx_py(spark, sf)
    number, n = F.regexp_extract("path", r"doc_(\d+)", 1).cast("int"), F.expr("CAST(substr(session_id, 4) AS INT)")
    fine = F.concat(F.lit("x = '"), F.repeat(F.lit("a"), number % 50), F.lit("'"))
    text = F.when((number % 5 < 2) & (n % 2 == 0), fine).otherwise(F.lit("def :"))
    packs = process_files(files.withColumn("content", F.encode(text, "UTF-8")), V.roots(spark, sf), _no_state(spark), PackOptions(home=V.HOME, part_bytes=700))
    return packs.select("session_id", "part", "parts", "output_text")


_C1 = f"""WITH {V.FX_FILES}, {_KEPT}, {V.FILE_STATE}, {_BLOCKS},
state AS (SELECT s.*, k.is_text AS found FROM file_state s LEFT JOIN kept k ON k.session_id = s.session_id
  AND k.path = s.selected_file),
body AS (SELECT s.session_id, {V.stripped("string_agg(block, '' ORDER BY path)")} AS body
  FROM blocks b JOIN state s ON b.session_id = s.session_id AND (s.selected_file IS NULL OR b.path = s.selected_file)
  GROUP BY s.session_id)"""
_C1_TEXT = """CASE WHEN s.selected_file IS NOT NULL AND NOT coalesce(s.found, false) THEN '# Error: Selected file '
  || regexp_extract(s.selected_file, '[^/]*$') || ' is ' || CASE WHEN s.found IS NULL THEN 'not found'
     ELSE 'not a text file' END || '.' ELSE {text} END"""


@query("c1_pack", f"{_C1} SELECT s.session_id, {V.ONE_PART}, {_C1_TEXT.format(text='b.body')} AS output_text "
                  "FROM state s LEFT JOIN body b USING (session_id)")
def _(spark, sf):
    options = PackOptions(home=V.HOME)
    packs = process_files(V.fx_files(spark, sf), V.roots(spark, sf), V.file_state(spark, sf), options)
    return packs.select("session_id", "part", "parts", "output_text")


_TREE_TEXT = "t.rendered || CASE WHEN b.body IS NULL THEN '' ELSE chr(10) || chr(10) || b.body END"


@query("c1_pack_with_tree", f"""{_C1}, {NODES}, {LINES}, {TREES}, o AS (
SELECT s.session_id, {_C1_TEXT.format(text=_TREE_TEXT)} AS output_text FROM state s LEFT JOIN body b USING (session_id)
  LEFT JOIN trees t ON t.base = '/home/u/code/' || s.session_id)
SELECT session_id, {V.ONE_PART}, output_text, {_LINE_COUNT} AS line_count FROM o""")
def _(spark, sf):
    options = PackOptions(home=V.HOME, include_tree=True)
    packs = process_files(
        V.fx_files(spark, sf),
        V.roots(spark, sf),
        V.file_state(spark, sf),
        options,
        V.listing(spark, sf),
        bases(spark, sf),
    )
    return packs.select("session_id", "part", "parts", "output_text", "line_count")


@query("c1_binary_only", f"""
WITH {V.FX_FILES} SELECT session_id, {V.ONE_PART}, '{NO_TEXT_FILES}' AS output_text
FROM fx_files WHERE doc_id % 8 = 6 AND {V.NOT_IGNORED} GROUP BY session_id
UNION ALL SELECT session_id, 0, 1, '' FROM fx_files WHERE doc_id % 8 = 6 GROUP BY session_id
HAVING bool_and(NOT ({V.NOT_IGNORED}))""")
def _(spark, sf):
    files = V.fx_files(spark, sf).where(F.col("path").endswith(".bin"))
    roots = V.roots(spark, sf).join(files.select("session_id").distinct(), "session_id", "left_semi")
    packs = process_files(files, roots, _no_state(spark), PackOptions(home=V.HOME))
    return packs.select("session_id", "part", "parts", "output_text")


@query("c1_errors", f"""
WITH {V.FX_PY} SELECT session_id, path, {V.display(True)} || ': Error processing - Syntax error in doc_'
  || CAST(doc_id AS VARCHAR) || '.py: line 1 - invalid syntax' AS error FROM fx_py WHERE NOT parses""")
def _(spark, sf):
    return pack_errors(process_files(V.fx_py(spark, sf), V.roots(spark, sf), _no_state(spark), PackOptions(home=V.HOME)))


@query("c3_update_selection", f"""{_CHOSEN}, shown AS (SELECT session_id, path, {PY_BLOCK} AS block FROM decided)
SELECT y.session_id, {V.ONE_PART}, coalesce({V.stripped("string_agg(s.block, '' ORDER BY s.path)")}, '') AS output_text
FROM py_state y LEFT JOIN shown s USING (session_id) WHERE y.has_items GROUP BY y.session_id""")
def _(spark, sf):
    """Sessions whose selection changed are packed anew; the single file comes in by its base name."""
    files, state = V.fx_py(spark, sf), V.py_state(spark, sf)
    after = state.withColumn("selected_file", F.substring_index("selected_file", "/", -1))
    before = state.select(
        "session_id",
        F.lit("All Files").alias("mode"),
        F.lit(None).cast("string").alias("selected_file"),
        F.array().cast("array<string>").alias("selected_items"),
    )
    no_roots = state.select("session_id", F.lit(None).cast("string").alias("root"))
    packs = update_selection(files, no_roots, before, after, PackOptions(home=V.HOME))
    return packs.select("session_id", "part", "parts", "output_text")
