"""Queries: streams run to completion over the given tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from registry import views as V
from registry.core import ORACLES, query, table
from registry.history import _REPLAYED
from registry.tables import _ANSWERED, _request_lines
from sheaf.operators.stale import stale_files
from sheaf.session import folder_names, remove_folder, scratch_path
from sheaf.streaming.intake import intake_stream
from sheaf.streaming.replay import current_history, replay_stream
from sheaf.streaming.serve import responses, serve
from sheaf.streaming.stale_poll import kept_hashes, poll_changes, poll_staleness


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parquet*")
    return events.selectExpr(
        "user_id AS session_id",
        "event_id AS seq",
        "CASE WHEN event_id % 97 = 0 AND user_id % 15 = 1 THEN 'reset' WHEN event_type = 'signup' THEN 'back' "
        "WHEN event_type = 'error' THEN 'forward' ELSE 'new' END AS op",
        "CAST(CAST(floor(value / 10) AS INT) AS STRING) AS st",
    )


def _run(log, spark, label):
    """Drain a change log into a table in the shared folder and read it back."""
    out, marks = scratch_path(spark, label), scratch_path(spark, label + "-marks")

    def write(batch, batch_id):
        # one folder per batch, so a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    started = (
        log.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return spark.read.parquet(out)


@query("t1_replay_stream", _REPLAYED)
def _(spark, sf):
    return current_history(_run(replay_stream(_event_stream(spark, sf)), spark, "replay"))


@query("t3_intake_stream", f"""
WITH {V.FX_HISTORY}, o AS (SELECT session_id, seq, '/in/' || st || '.py' AS st FROM fx_history),
k AS (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM o)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos, st,
  seq = max(seq) OVER (PARTITION BY session_id) AS is_cursor FROM k WHERE p IS DISTINCT FROM st""")
def _(spark, sf):
    opened = _event_stream(spark, sf).selectExpr("session_id", "seq", "'/in/' || st || '.py' AS path")
    return current_history(_run(intake_stream(opened), spark, "intake"))


@query("t2_stale_poll", f"""
WITH {V.STALE}, s AS (SELECT DISTINCT source AS session_id FROM documents)
SELECT s.session_id, CASE max(CASE status WHEN 'missing' THEN 3 WHEN 'error' THEN 2 WHEN 'modified' THEN 1 END)
  WHEN 3 THEN 'Files Missing!' WHEN 2 THEN 'File Errors!'
  WHEN 1 THEN 'Files Modified since this state. You may want to refresh.' END AS headline,
  nullif(count(status), 0) AS files FROM s LEFT JOIN stale USING (session_id) GROUP BY s.session_id""")
def _(spark, sf):
    """One tick of the staleness clock."""
    out = scratch_path(spark, "poll")
    done = []

    def sink(heads, batch_id):
        heads.write.mode("overwrite").parquet(f"{out}/tick={batch_id}")
        done.append(batch_id)

    clock = poll_staleness(
        spark, lambda: V.snapshots(spark, sf), lambda: V.files_now(spark, sf), sink, ["session_id"], interval_ms=200
    )
    try:
        while not done and clock.isActive:
            time.sleep(0.1)
    finally:
        clock.stop()
    if not done:
        raise clock.exception()
    return spark.read.parquet(f"{out}/tick={done[0]}").select("session_id", "headline", "files")


@query("t2_poll_incremental", """
SELECT source AS session_id, 'p' || CAST(doc_id AS VARCHAR) AS path,
  CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'fresh' END AS status,
  CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 17 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS read_at FROM documents""")
def _(spark, sf):
    """Two ticks: the second reads only the files whose length or time changed since the first."""
    folder, marks, done = scratch_path(spark, "hashes"), scratch_path(spark, "poll-marks"), []
    snapshots, now = V.snapshots(spark, sf), V.files_now(spark, sf)
    old = V.documents(spark, sf).selectExpr("'p' || CAST(doc_id AS STRING) AS path", "encode(text, 'UTF-8') AS content", "CAST(NULL AS STRING) AS error")

    def contents():
        return now.select("path", "content", "error") if done else old

    def list_now():
        number = F.substring("path", 2, 20).cast("bigint")
        touched = (number % 17 == 0) | (number % 7 == 0) if done else F.lit(False)
        mtime = F.when(touched, F.lit("2024-02-02").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp"))
        return contents().select("path", F.lit(False).alias("is_dir"), F.octet_length("content").cast("bigint").alias("length"), mtime.alias("mtime"))

    def read(listed):
        return listed.select("path").join(contents(), "path", "left")

    def sink(heads, batch_id):
        heads.write.format("noop").mode("overwrite").save()
        done.append(batch_id)

    # after the second tick there is no state to check, so later ones are skipped
    clock = poll_changes(spark, lambda: snapshots if len(done) < 2 else None, list_now, read, sink, ["session_id"], folder, marks, interval_ms=200)
    try:
        while len(done) < 2 and clock.isActive:
            time.sleep(0.1)
    finally:
        clock.stop()
    if len(done) < 2:
        raise clock.exception()
    kept = kept_hashes(spark, folder)
    found = snapshots.join(stale_files(snapshots, kept), ["session_id", "path"], "left").join(kept.select("path", "read_at"), "path", "left")
    return found.select("session_id", "path", F.coalesce("status", F.lit("fresh")).alias("status"), F.when(F.col("read_at").isNotNull(), (F.col("read_at") != done[0]).cast("int")).alias("read_at"))


@query("s9_serve", ORACLES["s9_responses"])
def _(spark, sf):
    """Requests answered as a stream whose last batch is run twice, as after a failure: each line has one response."""
    incoming, folder, marks = (scratch_path(spark, n) for n in ("stream-requests", "stream-responses", "serve-marks"))
    _request_lines(spark, sf).select("value").repartition(4).write.text(incoming)
    at = F.lit(_ANSWERED).cast("timestamp")

    def answer(asked):
        key = F.get_json_object("value", "$.key").cast("bigint")
        return asked.select("request", F.struct(key.alias("accepted")).alias("payload"))

    def run():
        lines = spark.readStream.option("maxFilesPerTrigger", 2).text(incoming).select("value", "_metadata")
        started = serve(lines, folder, marks, answer, allowed_dirs=[V.CODE], at=at)
        started.awaitTermination()
        if started.exception() is not None:
            raise started.exception()

    run()
    last = max(int(n) for n in folder_names(spark, f"{marks}/commits") if n.isdigit())
    remove_folder(spark, f"{marks}/commits/{last}")
    run()
    return responses(spark, folder).select(F.col("value").alias("line"))
