"""Queries: histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as V
from registry.core import query
from registry.packs import _LINE_COUNT, packs_in_parts
from registry.trees import LINES, NODES, TREES, bases
from sheaf.operators.history import (
    drop_repeats,
    file_list_digest,
    latest_selection,
    neighbours,
    open_events,
    positions,
    remove_broken,
    replay,
)
from sheaf.operators.stale import current_hashes, stale_files
from sheaf.plans.packs import refresh_states
from sheaf.session import scratch_path

_NEWS = "news AS (SELECT session_id, seq, st FROM fx_history WHERE op = 'new')"
_KEPT = """SELECT session_id, seq, st FROM (SELECT *, lag(st) OVER w AS p, row_number() OVER w AS k FROM news
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE k = 1 OR p IS DISTINCT FROM st"""


def _news(spark, sf):
    return V.fx_history(spark, sf).where("op = 'new'").select("session_id", "seq", "st")


def _hot_news(spark, sf):
    return V.hot_history(spark, sf).where("op = 'new'").select("session_id", "seq", "st")


@query("w1_drop_repeats", f"WITH {V.FX_HISTORY}, {_NEWS} {_KEPT}")
def _(spark, sf):
    return drop_repeats(_news(spark, sf), "st")


@query("w1_drop_repeats_sliced", f"WITH {V.HOT_HISTORY}, {_NEWS} {_KEPT}")
def _(spark, sf):
    """One session holds a third of all rows and is cut into slices."""
    news = _hot_news(spark, sf)
    return drop_repeats(news, "st", rows_per_slice=V.some_slices(news))


_POSITIONS = f"""WITH {{history}}, {_NEWS}, p AS (SELECT session_id, seq,
  row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos, count(*) OVER (PARTITION BY session_id) AS total
  FROM news) SELECT *, 'History: ' || pos || ' of ' || total AS label, pos > 1 AS can_go_back,
  pos < total AS can_go_forward FROM p"""


@query("w2_positions", _POSITIONS.format(history=V.FX_HISTORY))
def _(spark, sf):
    return positions(_news(spark, sf)).drop("st")


@query("w2_positions_sliced", _POSITIONS.format(history=V.HOT_HISTORY))
def _(spark, sf):
    news = _hot_news(spark, sf)
    return positions(news, rows_per_slice=V.some_slices(news)).drop("st")


_NEIGHBOURS = f"""WITH {{history}}, {_NEWS} SELECT session_id, seq, st,
  lag(st) OVER w AS previous_st, lag(seq) OVER w AS previous_seq, lead(st) OVER w AS next_st FROM news
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)"""


def _neighbour_columns(df):
    return df.select(
        "session_id",
        "seq",
        "st",
        F.col("previous.st").alias("previous_st"),
        F.col("previous.seq").alias("previous_seq"),
        F.col("next.st").alias("next_st"),
    )


@query("w3_neighbours", _NEIGHBOURS.format(history=V.FX_HISTORY))
def _(spark, sf):
    return _neighbour_columns(neighbours(_news(spark, sf), ["seq", "st"]))


@query("w3_neighbours_sliced", _NEIGHBOURS.format(history=V.HOT_HISTORY))
def _(spark, sf):
    news = _hot_news(spark, sf)
    return _neighbour_columns(neighbours(news, ["seq", "st"], rows_per_slice=V.some_slices(news)))


def _loading(spark, sf):
    """Two states per session, the cursor at the newer; moves of every kind; some older states cannot be loaded."""
    from sheaf.functions.paths import display_path
    from sheaf.operators.tree import tree_lines, tree_text
    from sheaf.plans.loading import load_states
    from sheaf.plans.packs import PackOptions

    files = V.fx_files(spark, sf)
    sessions = files.select("session_id").distinct().withColumn("n", F.expr("CAST(substr(session_id, 4) AS INT)"))
    states = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(st).alias("st"), F.lit(i == 1).alias("is_cursor")) for i, st in enumerate(["older", "newer"])])
    history = sessions.select("session_id", F.explode(states).alias("s")).select("session_id", "s.*")
    moves = sessions.selectExpr("session_id", "CASE n % 4 WHEN 2 THEN 1 WHEN 3 THEN -5 ELSE -1 END AS by")
    selections = sessions.where("n % 4 != 1").selectExpr(
        "session_id", "explode(array('older', 'newer')) AS st", "'All Files' AS mode", "CAST(NULL AS STRING) AS selected_file", "CAST(array() AS array<string>) AS selected_items")
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    listed = files.select("session_id", F.explode(F.when(number % 2 == 0, F.array(F.lit("older"), F.lit("newer"))).otherwise(F.array(F.lit("newer")))).alias("st"), "path")
    owners = bases(spark, sf).join(V.roots(spark, sf), "session_id").where("CAST(substr(session_id, 4) AS INT) % 8 != 0")
    owners = owners.select("session_id", "base", display_path("base", "root", V.HOME, show_ellipsis=True).alias("display"))
    drawn = tree_text(tree_lines(V.listing(spark, sf), owners), owners).join(owners.select("session_id", "base"), "base")
    trees = drawn.select("session_id", F.lit("older").alias("st"), "part", "parts", "rendered")
    # since then some files went and some grew; a tree drawn now would be another
    edited = F.when(number % 7 == 0, F.concat("content", F.lit(bytearray(b"!")))).otherwise(F.col("content"))
    now = files.withColumn("content", edited).where(number % 9 != 0)
    return load_states(history, moves, selections, listed, trees, now, V.roots(spark, sf), PackOptions(home=V.HOME))


@query("w3_load_state", f"""WITH {V.FX_FILES}, {NODES}, {LINES}, {TREES},
now AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text) FROM fx_files
  WHERE doc_id % 2 = 0 AND doc_id % 9 <> 0 AND is_text AND {V.NOT_IGNORED}),
body AS (SELECT session_id, rtrim(string_agg({V.block(V.display(True))}, '' ORDER BY path), chr(10)) AS body FROM now GROUP BY session_id),
whole AS (SELECT DISTINCT session_id, n FROM fx_files WHERE n % 4 IN (0, 3)),
o AS (SELECT w.session_id, CASE WHEN n % 8 = 0 THEN '' ELSE t.rendered || CASE WHEN b.body IS NULL THEN '' ELSE chr(10) || chr(10) END END
  || coalesce(b.body, '') AS output_text FROM whole w LEFT JOIN body b USING (session_id) LEFT JOIN trees t ON t.base = '/home/u/code/' || w.session_id)
SELECT session_id, {V.ONE_PART}, output_text, {_LINE_COUNT} AS line_count FROM o""")
def _(spark, sf):
    """Back to the older state: current contents of its files under the tree that was stored with it."""
    packs, _ = _loading(spark, sf)
    return packs.select("session_id", "part", "parts", "output_text", "line_count")


@query("w3_load_history", """
WITH s AS (SELECT DISTINCT source AS session_id, CAST(substr(source, 4) AS INT) % 4 AS k FROM documents)
SELECT session_id, CAST(0 AS BIGINT) AS pos, 'older' AS st, k IN (0, 3) AS is_cursor FROM s WHERE k <> 1
UNION ALL SELECT session_id, CAST(CASE WHEN k = 1 THEN 0 ELSE 1 END AS BIGINT), 'newer', k IN (1, 2) FROM s""")
def _(spark, sf):
    """Cursors after the moves; a state that could not be loaded is gone."""
    return _loading(spark, sf)[1]


@query("w3_stale_after_back", """
WITH v AS (SELECT source, doc_id, sha256(text) AS old_hash,
    sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS new_hash FROM documents WHERE doc_id % 9 <> 0)
SELECT source AS session_id, 'p' || CAST(doc_id AS VARCHAR) AS path, 'modified' AS status
FROM v WHERE old_hash <> new_hash AND doc_id % 17 <> 0
UNION ALL SELECT source, 'p' || CAST(doc_id AS VARCHAR), 'error' FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 17 = 0
UNION ALL SELECT source, 'p' || CAST(doc_id AS VARCHAR), 'missing' FROM documents WHERE doc_id % 9 = 0""")
def _(spark, sf):
    """Two states per session; after one "back" the cursor state is the older one."""
    older = V.snapshots(spark, sf).withColumn("st", F.lit("older"))
    newer = older.withColumns({"hash": F.sha2(F.col("hash").cast("string"), 256), "st": F.lit("newer")})
    sessions = older.select("session_id").distinct()
    ops = F.array(
        *[F.struct(F.lit(i).alias("seq"), F.lit(op).alias("op"), F.lit(st).alias("st"))
          for i, (op, st) in enumerate([("new", "older"), ("new", "newer"), ("back", None)])]
    )
    events = sessions.select("session_id", F.explode(ops).alias("e")).select("session_id", "e.*")
    cursor = replay(events).where("is_cursor").select("session_id", "st")
    stored = older.unionByName(newer).join(cursor, ["session_id", "st"], "left_semi").drop("st")
    return stale_files(stored, current_hashes(V.files_now(spark, sf)))


_REPLAY = "WITH RECURSIVE {history}, " + V.REPLAYED + " SELECT session_id, pos, st, is_cursor FROM replayed"
_REPLAYED = _REPLAY.format(history=V.FX_HISTORY)


@query("t1_replay", _REPLAYED)
def _(spark, sf):
    return replay(V.fx_history(spark, sf))


@query("t1_replay_split", _REPLAY.format(history=V.HOT_HISTORY))
def _(spark, sf):
    """One session holds a third of all events: its independent runs are replayed in parallel."""
    events = V.hot_history(spark, sf)
    return replay(events, rows_per_slice=V.some_slices(events))


@query("t1_replay_unsettled", _REPLAY.format(history=V.UNSETTLED_HISTORY))
def _(spark, sf):
    """No event of the hot session is beyond undoing: it is replayed by scans, in as many tasks as it has slices."""
    events = V.unsettled_history(spark, sf)
    return replay(events, rows_per_slice=V.some_slices(events, 12))


@query("t3_latest_selection", f"""
WITH {V.FX_HISTORY} SELECT session_id, arg_max('/in/' || st || '.py', seq) AS path FROM fx_history GROUP BY session_id""")
def _(spark, sf):
    opened = V.fx_history(spark, sf).selectExpr("session_id", "seq", "'/in/' || st || '.py' AS path")
    return latest_selection(opened)


@query("t3_open_events", f"""
WITH {V.FX_HISTORY}, o AS (SELECT session_id, seq, '/in/' || st || '.py' AS st FROM fx_history),
k AS (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM o)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos, st,
  seq = max(seq) OVER (PARTITION BY session_id) AS is_cursor FROM k WHERE p IS DISTINCT FROM st""")
def _(spark, sf):
    opened = V.fx_history(spark, sf).selectExpr("session_id", "seq", "'/in/' || st || '.py' AS path")
    return replay(open_events(opened))


_BROKEN = f"""WITH RECURSIVE {V.FX_HISTORY}, {V.REPLAYED},
kept AS (SELECT session_id, pos, st FROM replayed WHERE st NOT LIKE '%3'),
c AS (SELECT session_id, max(pos) FILTER (WHERE is_cursor) AS cur FROM replayed GROUP BY session_id),
r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS pos, st,
  count(*) OVER (PARTITION BY session_id) AS n FROM kept)
SELECT session_id, pos, st, pos = least(cur, n - 1) AS is_cursor FROM r JOIN c USING (session_id)"""


@query("t4_remove_broken", _BROKEN)
def _(spark, sf):
    history = replay(V.fx_history(spark, sf))
    broken = history.where(F.col("st").endswith("3")).select("session_id", "st")
    return remove_broken(history, broken)


@query("w1_refresh_digest", """
WITH s AS (SELECT source, sha256(text) AS h,
  sha256(CASE WHEN doc_id % 7 = 0 AND CAST(substr(source, 4) AS INT) % 2 = 0 THEN text || '!' ELSE text END) AS h2
  FROM documents)
SELECT source AS session_id, bool_or(h <> h2) AS changed FROM s GROUP BY source""")
def _(spark, sf):
    """Digests of two whole snapshots differ exactly where some file differs."""
    old = V.snapshots(spark, sf)
    edited = F.expr("doc_id % 7 = 0 AND CAST(substr(source, 4) AS INT) % 2 = 0")
    text = F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = V.documents(spark, sf).select(
        F.col("source").alias("session_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2(text, 256).alias("hash"),
    )
    a = file_list_digest(old, ["session_id"], ["path", "hash"]).withColumnRenamed("digest", "a")
    b = file_list_digest(new, ["session_id"], ["path", "hash"]).withColumnRenamed("digest", "b")
    return a.join(b, "session_id").select("session_id", (F.col("a") != F.col("b")).alias("changed"))


@query("c5_refresh", f"""
WITH {V.FX_FILES} SELECT session_id, CASE WHEN bool_or(is_text AND doc_id % 7 = 0 AND n % 2 = 0) THEN 2 ELSE 1 END
  AS states FROM fx_files GROUP BY session_id""")
def _(spark, sf):
    """Three refreshes: unchanged files make no new state, an edit makes one."""
    files = V.fx_files(spark, sf)
    number = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("bigint")
    hit = (number % 7 == 0) & (F.expr("CAST(substr(session_id, 4) AS INT)") % 2 == 0)
    # the edit must not move the byte at which the text check cuts
    changed = F.when(hit, F.concat("content", F.lit(bytearray(b"!")))).otherwise(F.col("content"))
    edited = files.withColumn("content", changed)
    state = V.file_state(spark, sf)
    first, second = refresh_states(files, state), refresh_states(edited, state)
    events = (
        first.withColumn("seq", F.lit(1))
        .unionByName(first.withColumn("seq", F.lit(2)))
        .unionByName(second.withColumn("seq", F.lit(3)))
        .withColumn("op", F.lit("new"))
    )
    return replay(events).groupBy("session_id").agg(F.count(F.lit(1)).alias("states"))


@query("c5_refresh_tree_change", """
SELECT DISTINCT source AS session_id, CAST(CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS states
FROM documents""")
def _(spark, sf):
    """A new file beside the selected ones changes the tree, and so makes a new state."""
    from sheaf.operators.tree import listing_of_files, tree_lines

    files, state = V.fx_files(spark, sf), V.file_state(spark, sf)
    owners = files.select("session_id", F.concat(F.lit(f"{V.CODE}/"), "session_id").alias("base")).distinct()
    added = owners.where("CAST(substr(session_id, 4) AS INT) % 2 = 0").select(F.concat("base", F.lit("/added.md")).alias("path"))
    seen = files.select("path")

    def state_of(paths):
        lines = tree_lines(listing_of_files(paths), owners.select("base"))
        tree = lines.join(owners, "base").select("session_id", "key", F.col("line").alias("text"))
        return refresh_states(files, state, tree)

    first, second = state_of(seen), state_of(seen.unionByName(added))
    events = first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2))).withColumn("op", F.lit("new"))
    return replay(events).groupBy("session_id").agg(F.count(F.lit(1)).alias("states"))


_EDITED = """edited AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN text || '!!' ELSE text END AS text,
    CASE WHEN doc_id % 50 = 0 THEN content || encode('!!') ELSE content END AS content) FROM fx_files WHERE doc_id % 97 <> 1)"""


def _inputs(name: str, rows: str) -> str:
    """SQL of what goes into each part of ``rows``."""
    return f"""{name}_w AS (SELECT *, coalesce(sum(2 * octet_length(content) + octet_length(encode(path)) + 256) OVER (PARTITION BY session_id
    ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000 AS step FROM {rows} WHERE is_text AND {V.NOT_IGNORED}),
{name} AS (SELECT session_id, part, string_agg(path || sha256(content), ',' ORDER BY path) AS inputs FROM (
  SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY step) - 1 AS part FROM {name}_w) GROUP BY ALL)"""


@query("c5_refresh_parts", f"""
WITH {V.FX_FILES}, {_EDITED}, {_inputs("before", "fx_files")}, {_inputs("after", "edited")},
b AS (SELECT session_id, path, octet_length(content) AS size, {V.block(V.display(True))} AS block FROM edited WHERE is_text AND {V.NOT_IGNORED}),
{packs_in_parts("b", 20_000)}
SELECT p.*, CASE WHEN o.inputs IS NULL THEN 1 ELSE 0 END AS tick FROM packs p JOIN after a USING (session_id, part)
  LEFT JOIN before o ON o.session_id = a.session_id AND o.inputs = a.inputs""")
def _(spark, sf):
    """Two refreshes: the second renders only the parts whose files changed, and reads no others."""
    from sheaf.functions.text import content_hash, is_text
    from sheaf.plans.packs import PackOptions
    from sheaf.plans.refresh import refresh_parts

    store = scratch_path(spark, "parts")
    before = V.fx_files(spark, sf)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    edit = F.when(number % 50 == 0, F.concat("content", F.lit(bytearray(b"!!")))).otherwise(F.col("content"))
    after = before.where(number % 97 != 1).withColumn("content", edit)
    none = spark.createDataFrame([], "session_id string, mode string, selected_file string, selected_items array<string>")
    options = PackOptions(home=V.HOME, part_bytes=20_000)

    def refresh(files, tick):
        entries = files.select(
            "session_id", "path", "mtime", F.octet_length("content").cast("bigint").alias("length"), content_hash("content").alias("current_hash"), is_text("content").alias("is_text"))
        read = lambda listed: listed.select("path").join(files.select("path", "content"), "path")
        return refresh_parts(entries, read, V.roots(spark, sf), none, options, store, tick)

    refresh(before, 0)
    return refresh(after, 1).select("session_id", "part", "parts", "output_text", F.col("tick").cast("int").alias("tick"))
