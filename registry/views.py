"""Views that map the given tables onto files, sources, histories and snapshots.

Each view exists twice: as a Spark DataFrame and as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.core import table
from sheaf.constants import IGNORE_DEFAULT

# SQL of texts whose size stays below PART_BYTES, as in the tables it runs on
ONE_PART = "CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts"
HOME = "/home/u"
CODE = "/home/u/code"

_PATH = """
  '/home/u/code/' || source
  || CASE WHEN doc_id % 11 = 0 THEN '/tmp' WHEN doc_id % 11 = 1 THEN '/legit' WHEN doc_id % 11 = 2 THEN '/.cache'
          ELSE '/src' END
  || '/' || lang || '/doc_' || CAST(doc_id AS {string})
  || CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.json' WHEN 3 THEN '.PY' WHEN 4 THEN '.html'
                     WHEN 5 THEN '.tar.yaml' WHEN 6 THEN '.bin' ELSE '' END"""

_RAW = """CASE WHEN doc_id % 8 = 6 THEN chr(0) || text
       WHEN doc_id % 8 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"""

_PY = """
  CASE WHEN doc_id % 13 = 0 THEN 'def :' ELSE
    'import os' || chr(10) || 'from ' || source || ' import ' || lang || '_x' || chr(10) || chr(10)
    || 'class Doc' || CAST(doc_id AS {string}) || ':' || chr(10) || '    def method(self):' || chr(10)
    || '        return ' || CAST(n_chars AS {string}) || chr(10) || chr(10)
    || CASE WHEN doc_id % 2 = 0
         THEN 'if True:' || chr(10) || '    def load_' || lang || '():' || chr(10) || '        import json' || chr(10)
              || '        return 1' || chr(10)
         ELSE 'async def load_' || lang || '():' || chr(10) || '    def inner():' || chr(10)
              || '        return 2' || chr(10) END
  END"""

_PY_PATH = "'/home/u/code/' || source || '/src/doc_' || CAST(doc_id AS {string}) || '.py'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, path, content, mtime."""
    return documents(spark, sf_dir).selectExpr(
        "source AS session_id",
        _PATH.format(string="STRING") + " AS path",
        f"encode({_RAW}, 'UTF-8') AS content",
        "timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP '2024-01-01 00:00:00') AS mtime",
    )


FX_FILES = f"""fx_files AS (
  SELECT *, replace(raw, chr(13) || chr(10), chr(10)) AS text,
         doc_id % 8 <> 6 AS is_text,
         doc_id % 8 <> 6 AND (octet_length(content) <= 1024
           OR substr(hex(content), 2049, 1) NOT IN ('8', '9', 'A', 'B')) AS is_text_strict,
         CASE doc_id % 8 WHEN 0 THEN 'markdown' WHEN 2 THEN 'json' WHEN 3 THEN 'python' WHEN 4 THEN 'html'
                         WHEN 5 THEN 'yaml' ELSE '' END AS language
  FROM (SELECT doc_id, source AS session_id, CAST(substr(source, 4) AS INT) AS n, lang,
          {_PATH.format(string="VARCHAR")} AS path,
          {_RAW} AS raw, encode({_RAW}) AS content,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS mtime
        FROM documents))"""

NOT_IGNORED = f"NOT regexp_matches(path, '{IGNORE_DEFAULT}')"
LABEL = "'**Last modified: ' || strftime(mtime, '%b %d, %Y %I:%M %p') || ' UTC**'"


def stripped(column: str) -> str:
    return f"trim({column}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def block(display: str) -> str:
    """SQL of the full block of an fx_files row."""
    return (
        f"'# ' || {display} || chr(10) || {LABEL} || chr(10) || chr(10) || '```' || language || chr(10) || "
        f"{stripped('text')} || chr(10) || '```' || chr(10) || chr(10)"
    )


def fx_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, path, content, mtime of generated Python sources."""
    return documents(spark, sf_dir).selectExpr(
        "source AS session_id",
        _PY_PATH.format(string="STRING") + " AS path",
        f"encode({_PY.format(string='STRING')}, 'UTF-8') AS content",
        "timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP '2024-01-01 00:00:00') AS mtime",
    )


FX_PY = f"""fx_py AS (
  SELECT doc_id, source AS session_id, CAST(substr(source, 4) AS INT) AS n, lang, source, n_chars,
    {_PY_PATH.format(string="VARCHAR")} AS path,
    {_PY.format(string="VARCHAR")} AS text,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS mtime,
    doc_id % 13 <> 0 AS parses, 'Doc' || CAST(doc_id AS VARCHAR) AS cls,
    CASE WHEN doc_id % 2 = 0 THEN 'load_' || lang ELSE 'inner' END AS fn,
    'class Doc' || CAST(doc_id AS VARCHAR) || ':' || chr(10) || chr(10) || '    def method(self):' || chr(10)
      || '        return ' || CAST(n_chars AS VARCHAR) AS cls_code,
    CASE WHEN doc_id % 2 = 0
      THEN 'def load_' || lang || '():' || chr(10) || '    import json' || chr(10) || '    return 1'
      ELSE 'def inner():' || chr(10) || '    return 2' END AS fn_code,
    'from ' || source || ' import ' || lang || '_x' AS from_import
  FROM documents)"""


def py_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections over fx_py: a third of the sessions select nothing, a third are single-file."""
    docs = documents(spark, sf_dir)
    number = F.expr("CAST(substr(source, 4) AS INT)")
    return (
        docs.groupBy(F.col("source").alias("session_id"), number.alias("n"))
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .selectExpr(
            "session_id",
            "CASE WHEN n % 3 = 2 THEN 'Single File' ELSE 'All Files' END AS mode",
            "CASE WHEN n % 3 = 2 THEN '/home/u/code/' || session_id || '/src/doc_' || "
            "CAST(last_doc AS STRING) || '.py' END AS selected_file",
            "CASE WHEN n % 3 = 0 THEN CAST(array() AS array<string>) "
            "ELSE array('load_en', 'Doc' || CAST(first_doc AS STRING)) END AS selected_items",
        )
    )


PY_STATE = """py_state AS (
  SELECT session_id, n,
    CASE WHEN n % 3 = 2 THEN 'Single File' ELSE 'All Files' END AS mode,
    CASE WHEN n % 3 = 2 THEN '/home/u/code/' || session_id || '/src/doc_' || CAST(last_doc AS VARCHAR) || '.py' END
      AS selected_file,
    n % 3 <> 0 AS has_items, 'Doc' || CAST(first_doc AS VARCHAR) AS wanted_cls
  FROM (SELECT source AS session_id, CAST(substr(source, 4) AS INT) AS n, min(doc_id) AS first_doc,
               max(doc_id) AS last_doc FROM documents GROUP BY source))"""


def file_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections over fx_files: all files; a text file; a file that is absent; a binary file."""
    rows = fx_files(spark, sf_dir).withColumn("is_bin", F.col("path").endswith(".bin"))
    return (
        rows.groupBy("session_id", F.expr("CAST(substr(session_id, 4) AS INT)").alias("n"))
        .agg(
            F.min(F.when(F.col("path").endswith(".txt"), F.col("path"))).alias("txt"),
            F.min(F.when(F.col("is_bin"), F.col("path"))).alias("bin"),
        )
        .selectExpr(
            "session_id",
            "CASE WHEN n % 4 = 0 THEN 'All Files' ELSE 'Single File' END AS mode",
            "CASE n % 4 WHEN 1 THEN txt WHEN 2 THEN '/nowhere/gone.md' WHEN 3 THEN bin END AS selected_file",
            "CAST(array() AS array<string>) AS selected_items",
        )
    )


FILE_STATE = """file_state AS (
  SELECT session_id, CASE WHEN n % 4 = 0 THEN 'All Files' ELSE 'Single File' END AS mode,
    CASE n % 4 WHEN 1 THEN txt WHEN 2 THEN '/nowhere/gone.md' WHEN 3 THEN bin END AS selected_file
  FROM (SELECT session_id, n, min(path) FILTER (WHERE path LIKE '%.txt') AS txt,
               min(path) FILTER (WHERE path LIKE '%.bin') AS bin FROM fx_files GROUP BY session_id, n))"""


def fx_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, op, st; event ids grow with time."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS session_id",
        "event_id AS seq",
        "CASE WHEN event_id % 97 = 0 AND user_id % 15 = 1 THEN 'reset' WHEN event_type = 'signup' THEN 'back' "
        "WHEN event_type = 'error' THEN 'forward' ELSE 'new' END AS op",
        "CAST(CAST(floor(value / 10) AS INT) AS STRING) AS st",
    )


def hot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_history with a third of all events in one session."""
    hot = F.when(F.col("session_id") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("session_id"))
    return fx_history(spark, sf_dir).withColumn("session_id", hot)


_UNSETTLED_OP = """CASE CAST(floor(value * 97) AS BIGINT) % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'new' WHEN 2 THEN 'new' WHEN 3 THEN 'back'
  WHEN 4 THEN 'back' WHEN 5 THEN 'back' WHEN 6 THEN 'forward' ELSE CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'back' END END"""


def unsettled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many undos as pushes, a third of all events in one session: its cursor comes back to the bottom again and again."""
    return table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS session_id",
        "event_id AS seq",
        f"{_UNSETTLED_OP} AS op",
        "CAST(CAST(floor(value / 10) AS INT) AS STRING) AS st",
    )


UNSETTLED_HISTORY = f"""fx_history AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM (
  SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS session_id, event_id AS seq, {_UNSETTLED_OP} AS op,
    CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) AS st FROM events))"""


def some_slices(df: DataFrame, slices: int = 6) -> int:
    """A slice size that cuts the table, and so its hot key, into a few slices."""
    return max(1, df.count() // slices)


_HISTORY = """fx_history AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn FROM (
  SELECT {session} AS session_id, event_id AS seq, ts,
    CASE WHEN event_id % 97 = 0 AND user_id % 15 = 1 THEN 'reset' WHEN event_type = 'signup' THEN 'back'
         WHEN event_type = 'error' THEN 'forward' ELSE 'new' END AS op,
    CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) AS st
  FROM events))"""
FX_HISTORY = _HISTORY.format(session="user_id")
HOT_HISTORY = _HISTORY.format(session="CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END")

REPLAYED = """steps AS (
  SELECT session_id, rn, CASE WHEN op = 'new' THEN [st] ELSE CAST([] AS VARCHAR[]) END AS h,
         CASE WHEN op = 'new' THEN 0 ELSE -1 END AS i
  FROM fx_history WHERE rn = 1
  UNION ALL
  SELECT e.session_id, e.rn,
    CASE WHEN e.op = 'reset' THEN CAST([] AS VARCHAR[])
         WHEN e.op = 'new' AND NOT (s.i >= 0 AND s.h[s.i + 1] = e.st) THEN list_append(s.h[1:s.i + 1], e.st)
         ELSE s.h END,
    CASE WHEN e.op = 'reset' THEN -1
         WHEN e.op = 'new' AND s.i >= 0 AND s.h[s.i + 1] = e.st THEN s.i
         WHEN e.op = 'new' THEN s.i + 1
         WHEN len(s.h) = 0 THEN -1
         WHEN e.op = 'back' THEN greatest(s.i - 1, 0)
         ELSE least(s.i + 1, CAST(len(s.h) AS INT) - 1) END
  FROM steps s JOIN fx_history e ON e.session_id = s.session_id AND e.rn = s.rn + 1),
final AS (
  SELECT session_id, h, i FROM steps
  WHERE (session_id, rn) IN (SELECT session_id, max(rn) FROM fx_history GROUP BY session_id)),
replayed AS (
  SELECT session_id, CAST(p AS BIGINT) AS pos, h[p + 1] AS st, p = i AS is_cursor
  FROM (SELECT session_id, h, i, unnest(range(len(h))) AS p FROM final))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored side: session_id, path, hash."""
    return documents(spark, sf_dir).select(
        F.col("source").alias("session_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("hash"),
    )


def files_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current side: some files gone, some changed, some unreadable."""
    return documents(spark, sf_dir).where("doc_id % 9 <> 0").selectExpr(
        "source AS session_id",
        "'p' || CAST(doc_id AS STRING) AS path",
        "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN encode(text || '!', 'UTF-8') "
        "ELSE encode(text, 'UTF-8') END AS content",
        "CASE WHEN doc_id % 17 = 0 THEN 'error' END AS error",
    )


def shared_paths(spark: SparkSession, sf_dir: str, sides: str) -> DataFrame:
    """``snapshots`` or ``files_now`` with paths that several sessions share, one of them in a third of the rows."""
    rows = snapshots(spark, sf_dir) if sides == "snapshots" else files_now(spark, sf_dir)
    path = "CASE WHEN CAST(substr(path, 2) AS BIGINT) % 3 = 0 THEN 'p0' ELSE 'p' || CAST(CAST(substr(path, 2) AS BIGINT) % 50 AS STRING) END"
    if sides == "snapshots":
        return rows.selectExpr("session_id", f"{path} AS path", "'old' AS hash").distinct()
    return rows.where("error IS NULL").selectExpr("session_id", f"{path} AS path", "encode('new', 'UTF-8') AS content")


STALE = """stale AS (
  SELECT source AS session_id, 'p' || CAST(doc_id AS VARCHAR) AS path,
    CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'modified' END AS status
  FROM documents WHERE doc_id % 9 = 0 OR doc_id % 17 = 0 OR doc_id % 7 = 0)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fx_files path and every directory above it, with a marker in even sessions."""
    from sheaf.operators.tree import listing_of_files

    files = fx_files(spark, sf_dir).select("path")
    markers = (
        documents(spark, sf_dir)
        .where("CAST(substr(source, 4) AS INT) % 2 = 0")
        .select(F.concat(F.lit("/home/u/code/"), "source", F.lit("/.git")).alias("path"))
        .distinct()
    )
    return listing_of_files(files.unionByName(markers))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, root) with a root two parts deep, three parts deep, or none."""
    return documents(spark, sf_dir).select("source").distinct().selectExpr(
        "source AS session_id",
        "CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 3 THEN '/home/u/code/' || source || '/src' "
        "WHEN CAST(substr(source, 4) AS INT) % 4 <> 1 THEN '/home/u/code/' || source END AS root",
    )


def display(ellipsis: bool, path: str = "path") -> str:
    """SQL of the display path of an fx_files row under ``roots``."""
    if not ellipsis:
        return f"'~/' || substr({path}, 9)"
    return (
        f"CASE WHEN n % 4 = 3 AND {path} LIKE '/home/u/code/' || session_id || '/src/%' "
        f"THEN '~/code/…/src/' || substr({path}, length('/home/u/code/' || session_id || '/src/') + 1) "
        f"ELSE '~/' || substr({path}, 9) END"
    )
