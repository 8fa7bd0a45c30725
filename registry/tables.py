"""Queries: records written and read back, requests, directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query, table
from registry.packs import A2
from sheaf.constants import ACTIONS, BAD_PATH, BAD_SESSION_ID, MODE_ALL
from sheaf.functions.text import decode_text
from sheaf.operators.requests import missing_files, split_by_existence, validate
from sheaf.plans.packs import PackOptions, process_files
from sheaf.schema import SESSION
from sheaf.session import scratch_path
from sheaf.sources.contents import read_contents
from sheaf.sources.export import export_blocks, export_packs, exported_digests, exported_pieces
from sheaf.sources.listing import list_directory, list_tree
from sheaf.sources.ndjson import error_response, parse_requests, read_requests, success_response, write_lines
from sheaf.sources.sessions import parse_sessions, read_sessions, read_states, session_json, write_sessions, write_states


def _conversations(spark, sf):
    return table(spark, sf, "conversations")


def _sessions(spark, sf):
    """A session record per conversation turn."""
    return _conversations(spark, sf).select(
        "conv_id",
        "turn",
        F.struct(
            F.expr("'s' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)").alias("id"),
            F.expr("timestampadd(SECOND, CAST(turn AS INT), TIMESTAMP '2024-01-01 00:00:00')").alias("timestamp"),
            F.array(F.lit("/a/b.py"), F.concat(F.lit("/a/"), "role", F.lit(".md"))).alias("files"),
            F.array(
                F.struct(
                    F.lit("/a/b.py").alias("path"),
                    F.lit("~/b.py").alias("display_path"),
                    F.lit(True).alias("is_text_file"),
                    F.lit("python").alias("language"),
                    F.lit(None).cast("timestamp").alias("last_modified"),
                    F.sha2("text", 256).alias("file_hash"),
                    F.length("text").cast("bigint").alias("size_bytes"),
                )
            ).alias("file_metadata"),
            F.struct(
                F.lit(MODE_ALL).alias("mode"),
                F.lit(None).cast("string").alias("selected_file"),
                F.array(F.col("role")).alias("selected_items"),
            ).alias("selection_state"),
            F.lit("/a").alias("project_root"),
            F.struct(
                F.lit("/a").alias("base_path"),
                F.lit("a/").alias("base_path_display"),
                F.lit("tmp").alias("ignore_regex"),
                F.lit("a/\n└── b.py").alias("rendered"),
            ).alias("tree_snapshot"),
            F.col("text").alias("output_text"),
            F.parse_json(F.lit('{"auto_copy":false,"include_tree":true}')).alias("settings"),
        ).cast(SESSION).alias("session"),
    )


_ID = "'s' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"


@query("s5_session_json", f"""
SELECT {_ID} AS id, to_json({{'id': {_ID}, 'timestamp': '2024-01-01T00:00:0' || CAST(turn AS VARCHAR) || '+00:00',
  'files': ['/a/b.py', '/a/' || role || '.md'],
  'file_metadata': [{{'path': '/a/b.py', 'display_path': '~/b.py', 'is_text_file': true, 'language': 'python',
    'last_modified': CAST(NULL AS VARCHAR), 'file_hash': sha256(text), 'size_bytes': length(text)}}],
  'selection_state': {{'mode': 'All Files', 'selected_file': CAST(NULL AS VARCHAR), 'selected_items': [role]}},
  'project_root': '/a', 'tree_snapshot': {{'base_path': '/a', 'base_path_display': 'a/', 'ignore_regex': 'tmp',
    'rendered': 'a/' || chr(10) || '└── b.py'}},
  'output_text': text, 'settings': {{'auto_copy': false, 'include_tree': true}}}})::VARCHAR AS line FROM conversations""")
def _(spark, sf):
    return _sessions(spark, sf).select(F.col("session.id").alias("id"), session_json().alias("line"))


_SESSION_COLUMNS = f"""SELECT {_ID} AS id, CAST(turn AS INT) AS sec, '/a/' || role || '.md' AS second_file,
  sha256(text) AS file_hash, 'All Files' AS mode, role AS item, 'a/' || chr(10) || '└── b.py' AS rendered,
  text AS output_text, true AS include_tree FROM conversations"""


def _session_columns(sessions):
    return sessions.select(
        F.col("session.id").alias("id"),
        F.second("session.timestamp").alias("sec"),
        F.get("session.files", F.lit(1)).alias("second_file"),
        F.get("session.file_metadata", F.lit(0))["file_hash"].alias("file_hash"),
        F.col("session.selection_state.mode").alias("mode"),
        F.get("session.selection_state.selected_items", F.lit(0)).alias("item"),
        F.col("session.tree_snapshot.rendered").alias("rendered"),
        F.col("session.output_text").alias("output_text"),
        F.try_variant_get("session.settings", "$.include_tree", "boolean").alias("include_tree"),
    )


@query("c4_save_and_load", _SESSION_COLUMNS)
def _(spark, sf):
    """Sessions written as JSON lines and read back."""
    path = scratch_path(spark, "sessions")
    write_sessions(_sessions(spark, sf), path)
    good, _ = read_sessions(spark, path)
    return _session_columns(good)


def _damaged_lines(spark, sf):
    full = session_json()
    return _sessions(spark, sf).select(
        F.col("session.id").alias("key"),
        F.when(F.col("turn") % 5 == 1, F.substring(full, 1, 20))
        .when(F.col("turn") % 5 == 2, F.regexp_replace(full, '"files":', '"fils":'))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit('{"id":"'), "session.id", F.lit('","timestamp":"2024-01-01T00:00:00Z","files":[]}')))
        .otherwise(full)
        .alias("value"),
    )


@query("s4_session_defaults", f"""
SELECT {_ID} AS id, CASE WHEN turn % 5 = 3 THEN 0 ELSE 1 END AS metadata, 'All Files' AS mode,
  CASE WHEN turn % 5 = 3 THEN 0 ELSE 1 END AS items, CASE WHEN turn % 5 = 3 THEN '{{}}'
    ELSE '{{"auto_copy":false,"include_tree":true}}' END AS settings FROM conversations WHERE turn % 5 IN (0, 3, 4)""")
def _(spark, sf):
    good, _ = parse_sessions(_damaged_lines(spark, sf))
    return good.select(
        F.col("session.id").alias("id"),
        F.size("session.file_metadata").alias("metadata"),
        F.col("session.selection_state.mode").alias("mode"),
        F.size("session.selection_state.selected_items").alias("items"),
        F.to_json("session.settings").alias("settings"),
    )


@query("s4_session_rejects", f"""
SELECT {_ID} AS key, CASE turn % 5 WHEN 1 THEN 'malformed' ELSE 'files' END AS problem FROM conversations
WHERE turn % 5 IN (1, 2)""")
def _(spark, sf):
    _, rejects = parse_sessions(_damaged_lines(spark, sf))
    return rejects.select("key", "problem")


def _states(spark, sf):
    return _conversations(spark, sf).select(
        F.col("conv_id").alias("session_id"),
        F.expr("'st-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)").alias("id"),
        F.expr("timestampadd(MINUTE, CAST(turn AS INT), TIMESTAMP '2024-01-01 00:00:00')").alias("timestamp"),
        F.array(F.concat(F.lit("/a/"), "role")).alias("files"),
        F.array().cast("array<string>").alias("selected_items"),
        F.lit(MODE_ALL).alias("selection_mode"),
        F.lit(None).cast("string").alias("selected_file"),
        F.create_map(F.concat(F.lit("/a/"), "role"), F.sha2("text", 256)).alias("file_hashes"),
        F.lit(None).cast("struct<base_path:string,base_path_display:string,ignore_regex:string,rendered:string>").alias("tree"),
    )


@query("s6_s7_states", """
SELECT conv_id AS session_id, 'st-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
  CAST(turn AS INT) AS min, '/a/' || role AS file, sha256(text) AS hash FROM conversations""")
def _(spark, sf):
    path = scratch_path(spark, "states")
    write_states(_states(spark, sf), path)
    good, _ = read_states(spark, path, "bigint")
    return good.select(
        "session_id",
        "id",
        F.minute("timestamp").alias("min"),
        F.get("files", F.lit(0)).alias("file"),
        F.col("file_hashes")[F.get("files", F.lit(0))].alias("hash"),
    )


@query("s7_broken_states", """
SELECT conv_id AS session_id, '{"session_id":' || CAST(conv_id AS VARCHAR) || ',"id": "st-' || CAST(turn AS VARCHAR) AS value
FROM conversations WHERE turn % 4 = 3""")
def _(spark, sf):
    path = scratch_path(spark, "states")
    write_states(_states(spark, sf), path)
    broken = _conversations(spark, sf).where("turn % 4 = 3").select(
        F.concat(F.lit('{"session_id":'), "conv_id", F.lit(',"id": "st-'), "turn").alias("value"), F.lit(0).alias("bucket")
    )
    broken.write.mode("append").partitionBy("bucket").text(path)
    _, rejected = read_states(spark, path, "bigint")
    return rejected.select("session_id", "value")


@query("s8_export", f"SELECT session_id, part, rtrim(output_text, chr(10)) AS output_text FROM ({A2})")
def _(spark, sf):
    """Packs exported as Markdown files, read back whole."""
    from registry.packs import all_files_pack

    packs = all_files_pack(spark, sf)
    path = scratch_path(spark, "export")
    export_packs(packs, path, F.expr("TIMESTAMP '2024-05-06 07:08:09'"))
    back = spark.read.text(path, wholetext=True)
    return back.where("stamp = '20240506_070809'").select(
        "session_id", F.col("part").cast("bigint").alias("part"), F.regexp_replace("value", r"\n\z", "").alias("output_text")
    )


_EXPORTED = f"""WITH {V.FX_FILES}, h AS (SELECT session_id, hex(encode(string_agg({V.block(V.display(True))}, '' ORDER BY path))) AS h
  FROM fx_files WHERE is_text GROUP BY session_id)"""


@query("s8_export_pieces", f"""{_EXPORTED},
p AS (SELECT session_id, h, unnest(range(CAST(ceil(len(h) / 2.0 / 10000) AS BIGINT))) AS piece FROM h),
s AS (SELECT session_id, piece, substr(h, piece * 20000 + 1, 20000) AS h FROM p)
SELECT session_id, piece, len(h) // 2 AS size, sha256(unhex(h)) AS digest FROM s""")
def _(spark, sf):
    """An export checked piece by piece, every piece by whichever task has it."""
    return exported_pieces(spark, _exported_blocks(spark, sf), piece_bytes=10_000)


@query("s8_export_parts", f"""
WITH {V.FX_FILES} SELECT session_id, sha256(string_agg({V.block(V.display(True))}, '' ORDER BY path)) AS joined
FROM fx_files WHERE is_text GROUP BY session_id""")
def _(spark, sf):
    """Blocks exported without building packs; a folder's files in name order hold the blocks in order."""
    return exported_digests(spark, _exported_blocks(spark, sf))


def _exported_blocks(spark, sf):
    """The folder to which the blocks of all sessions are exported."""
    from sheaf.functions.paths import display_path, language
    from sheaf.functions.text import is_text
    from sheaf.functions.times import modified_line
    from sheaf.operators.render import full_block

    joined = V.fx_files(spark, sf).where(is_text("content")).join(V.roots(spark, sf), "session_id")
    shown = display_path("path", "root", V.HOME, show_ellipsis=True)
    block = full_block(shown, modified_line("mtime"), language("path"), decode_text("content"))
    path = scratch_path(spark, "export-blocks")
    export_blocks(joined.select("session_id", "path", block.alias("block")), path, ["path"])
    return path


@query("s1_s3_directory", """
SELECT source, lang, doc_id, sha256(text) AS text_hash FROM documents""")
def _(spark, sf):
    """Documents written below source/lang folders, listed by the data source and read late."""
    path = scratch_path(spark, "tree")
    line = F.to_json(F.struct("doc_id", "text"))
    V.documents(spark, sf).select("source", "lang", line.alias("value")).write.partitionBy("source", "lang").text(path)
    listed = list_directory(spark, path, ignore="_SUCCESS")
    files = read_contents(listed)
    lines = files.select("path", F.explode(F.split(decode_text("content"), "\n")).alias("line")).where("line <> ''")
    record = F.from_json("line", "doc_id bigint, text string")
    return lines.select(
        F.regexp_extract("path", "source=([^/]+)", 1).alias("source"),
        F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"),
        record.alias("r"),
    ).select("source", "lang", "r.doc_id", F.sha2("r.text", 256).alias("text_hash"))


@query("s1_rounds", """
SELECT source, lang, count(*) AS docs, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY ALL""")
def _(spark, sf):
    """The same folders listed in rounds by URI, two folders a task, and read through the store's own reader."""
    path = scratch_path(spark, "tree")
    line = F.to_json(F.struct("doc_id", "text"))
    V.documents(spark, sf).select("source", "lang", line.alias("value")).write.partitionBy("source", "lang").text(path)
    uri = path if ":/" in path else f"file://{path}"
    files = read_contents(list_tree(spark, uri, ignore="_SUCCESS", folders_per_task=2))
    lines = files.select("path", F.explode(F.split(decode_text("content"), "\n")).alias("line")).where("line <> ''")
    record = F.from_json("line", "doc_id bigint, text string")
    return lines.select(
        F.regexp_extract("path", "source=([^/]+)", 1).alias("source"),
        F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"),
        record.alias("r"),
    ).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("r.text")).cast("bigint").alias("bytes"))


# ---- requests ----


def _request_lines(spark, sf):
    """A request per conversation turn; most kinds of damage occur."""
    kind = "(conv_id + turn) % 10"
    key = "conv_id * 1000 + turn"
    rows = _conversations(spark, sf).selectExpr(
        f"{key} AS key",
        f"{kind} AS kind",
        f"'00000000-0000-4000-8000-' || lpad(CAST({key} AS STRING), 12, '0') AS uuid",
        f"'/home/u/code/f' || CAST(({key}) % 7 AS STRING) || '.py' AS file",
    )
    files = F.expr(
        "CASE kind WHEN 4 THEN array('rel/x.py') WHEN 5 THEN array('/home/u/code/../x') "
        "WHEN 6 THEN array('/etc/passwd') WHEN 3 THEN NULL ELSE array(file, '/home/u/code/f1.py') END"
    )
    payload = F.struct(
        F.when(F.col("kind") < 8, files).alias("files"),
        F.when(F.col("kind") == 8, F.struct(F.lit("All Files").alias("mode"))).alias("selection_state"),
        F.when(F.col("kind") == 9, F.col("file")).alias("file_path"),
    )
    action = F.expr(
        "CASE kind WHEN 1 THEN 'explode' WHEN 8 THEN 'update_selection' WHEN 9 THEN 'load_session' "
        "ELSE 'process_files' END"
    )
    session = F.when(F.col("kind") == 2, F.lit("invalid-session-id")).otherwise(F.col("uuid"))
    line = F.to_json(
        F.struct(
            F.col("key"),
            action.alias("action"),
            session.alias("session_id"),
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            payload.alias("payload"),
        )
    )
    return rows.select("key", "kind", F.when(F.col("kind") == 7, F.lit("{not json")).otherwise(line).alias("value"))


_KIND = "requests AS (SELECT conv_id * 1000 + turn AS key, (conv_id + turn) % 10 AS kind FROM conversations)"


@query("f9_rejects", f"""
WITH {_KIND} SELECT key, CASE kind WHEN 6 THEN 'PermissionError' ELSE 'ValidationError' END AS type,
  CASE kind WHEN 1 THEN 'Unknown action' WHEN 2 THEN 'Invalid session ID format'
    WHEN 3 THEN 'Missing payload field files' WHEN 6 THEN 'Path outside allowed directories'
    WHEN 7 THEN 'Malformed JSON request' ELSE 'Invalid file path provided' END AS message,
  CASE kind WHEN 1 THEN 'explode' WHEN 2 THEN 'invalid-session-id' WHEN 3 THEN 'files' WHEN 4 THEN 'rel/x.py'
    WHEN 5 THEN '/home/u/code/../x' WHEN 6 THEN '/etc/passwd' ELSE '{{not json' END AS received
FROM requests WHERE kind BETWEEN 1 AND 7""")
def _(spark, sf):
    _, rejects = validate(parse_requests(_request_lines(spark, sf)), [V.CODE], max_bytes=10_000)
    return rejects.select(
        "key", "error.type", "error.message", F.try_variant_get("error.details", "$.received", "string").alias("received")
    )


@query("f9_valid", f"WITH {_KIND} SELECT key, kind FROM requests WHERE kind IN (0, 8, 9)")
def _(spark, sf):
    valid, _ = validate(parse_requests(_request_lines(spark, sf)), [V.CODE], max_bytes=10_000)
    return valid.select("key", "kind")


def _present(spark, sf):
    """The files that exist: named f0.py to f3.py, as the conversations mention them."""
    return _conversations(spark, sf).selectExpr(
        "'/home/u/code/f' || CAST((conv_id * 1000 + turn) % 4 AS STRING) || '.py' AS path", "false AS is_dir"
    ).distinct()


def _valid(spark, sf):
    valid, _ = validate(parse_requests(_request_lines(spark, sf)), [V.CODE])
    return valid


@query("j7_accessible", f"""
WITH {_KIND} SELECT key, '/home/u/code/f' || CAST(key % 7 AS VARCHAR) || '.py' AS path, key % 7 < 4 AS accessible
FROM requests WHERE kind IN (0, 9) UNION ALL SELECT key, '/home/u/code/f1.py', true FROM requests WHERE kind = 0""")
def _(spark, sf):
    return split_by_existence(_valid(spark, sf), "key", _present(spark, sf))


@query("j7_missing_files", f"""
WITH {_KIND} SELECT key, 'FileNotFoundError' AS type, '{{"accessible_files":[' || CASE kind WHEN 0 THEN '"/home/u/code/f1.py"' ELSE '' END
  || '],"missing_files":["/home/u/code/f' || CAST(key % 7 AS VARCHAR) || '.py"]}}' AS details
FROM requests WHERE kind IN (0, 9) AND key % 7 >= 4""")
def _(spark, sf):
    errors = missing_files(_valid(spark, sf), "key", _present(spark, sf))
    return errors.select("key", "error.type", F.to_json("error.details").alias("details"))


_BAD = """CASE kind WHEN 1 THEN {unknown} WHEN 2 THEN {session} WHEN 3 THEN {field} WHEN 4 THEN {relative} WHEN 5 THEN {parent}
  WHEN 6 THEN {outside} ELSE {malformed} END"""


def _error_sql(kind: str, message: str, field: str, expected: str, received: str) -> str:
    details = f'{{"expected":"{expected}","field":"{field}","received":"{received}"}}'
    return f"""'{{"type":"{kind}","message":"{message}","details":{details}}}'"""


_ERRORS = _BAD.format(
    unknown=_error_sql("ValidationError", "Unknown action", "action", ", ".join(ACTIONS), "explode"),
    session=_error_sql("ValidationError", BAD_SESSION_ID[1], "session_id", BAD_SESSION_ID[2], "invalid-session-id"),
    field=_error_sql("ValidationError", "Missing payload field files", "payload", "Required fields", "files"),
    relative=_error_sql("ValidationError", BAD_PATH, "path", "Absolute path", "rel/x.py"),
    parent=_error_sql("ValidationError", BAD_PATH, "path", "No parent references", "/home/u/code/../x"),
    outside=_error_sql("PermissionError", "Path outside allowed directories", "path", V.CODE, "/etc/passwd"),
    malformed=_error_sql("ValidationError", "Malformed JSON request", "request", "One JSON object per line", "{not json"),
)
_ANSWERED = "2024-05-06T07:08:09Z"


@query("s9_responses", f"""
WITH {_KIND}, r AS (SELECT *, '"00000000-0000-4000-8000-' || lpad(CAST(key AS VARCHAR), 12, '0') || '"' AS uuid FROM requests)
SELECT '{{"action":' || CASE kind WHEN 7 THEN 'null' WHEN 1 THEN '"explode"' WHEN 8 THEN '"update_selection"' WHEN 9 THEN '"load_session"'
    ELSE '"process_files"' END || ',"session_id":' || CASE kind WHEN 7 THEN 'null' WHEN 2 THEN '"invalid-session-id"' ELSE uuid END
  || ',"timestamp":"{_ANSWERED}","success":' || CASE WHEN kind IN (0, 8, 9) THEN 'true,"payload":{{"accepted":' || CAST(key AS VARCHAR) || '}}'
    ELSE 'false,"error":' || {_ERRORS} END || '}}' AS line FROM r""")
def _(spark, sf):
    """Requests of every kind written as lines, read, validated, answered, written and read again."""
    incoming, outgoing = scratch_path(spark, "requests"), scratch_path(spark, "responses")
    write_lines(_request_lines(spark, sf), incoming)
    valid, rejects = validate(read_requests(spark, incoming), [V.CODE])
    action, session = F.col("request.action"), F.col("request.session_id").alias("session_id")
    accepted = F.struct(F.get_json_object("value", "$.key").cast("bigint").alias("accepted"))
    at = F.lit(_ANSWERED).cast("timestamp")
    good = valid.select("*", action.alias("action"), session).select(
        success_response(F.col("action"), "session_id", accepted, at).alias("value")
    )
    bad = rejects.select("*", action.alias("action"), session).select(
        error_response("action", "session_id", "error", at=at).alias("value")
    )
    write_lines(good.unionByName(bad), outgoing)
    return spark.read.text(outgoing).select(F.col("value").alias("line"))


@query("c1_from_requests", f"""
WITH {_KIND}, f AS (SELECT key, doc_id, text FROM requests JOIN documents
  ON doc_id = (key // 1000 * 10 + key % 1000) % (SELECT count(*) FROM documents) WHERE kind = 0)
SELECT '00000000-0000-4000-8000-' || lpad(CAST(key AS VARCHAR), 12, '0') AS session_id, {V.ONE_PART},
  '# /data/' || CAST(doc_id AS VARCHAR) || '.md' || chr(10) || '**Last modified: ?**' || chr(10) || chr(10)
  || '```markdown' || chr(10) || {V.stripped('text')} || chr(10) || '```' AS output_text FROM f""")
def _(spark, sf):
    """All requests parsed and validated; the process_files ones joined with the files they name, packed per session."""
    valid, _ = validate(parse_requests(_request_lines(spark, sf)), [V.CODE])
    number = f"(key div 1000 * 10 + key % 1000) % {V.documents(spark, sf).count()}"
    requests = valid.where("request.action = 'process_files'").selectExpr(
        "request.session_id AS session_id", f"'/data/' || CAST({number} AS STRING) || '.md' AS path"
    )
    docs = V.documents(spark, sf).selectExpr(
        "'/data/' || CAST(doc_id AS STRING) || '.md' AS path",
        "encode(text, 'UTF-8') AS content",
        "CAST(NULL AS timestamp) AS mtime",
    )
    files = requests.join(docs, "path")
    roots = files.select("session_id", F.lit(None).cast("string").alias("root")).distinct()
    none = spark.createDataFrame([], "session_id string, mode string, selected_file string, selected_items array<string>")
    packs = process_files(files, roots, none, PackOptions(home=V.HOME))
    return packs.select("session_id", "part", "parts", "output_text")
