"""Requests in, responses out: the whole exchange as one stream with an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.requests import missing_files, validate
from sheaf.session import folder_names
from sheaf.sources.ndjson import error_response, parse_requests, success_response

RESPONSES = "batch bigint, request string, success boolean, value string"


def respond(
    lines: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    listing: DataFrame | None = None,
    allowed_dirs: list[str] | None = None,
    max_bytes: int | None = None,
    at: Column | None = None,
) -> DataFrame:
    """One response per request line: request, success, value.

    ``lines``: request (an identifier that stays the same when the line is read again) and value (one JSON line).  ``answer`` turns the valid requests (request, value
    and the envelope in ``request_data``) into request, payload (a struct).  Requests that are not valid, name files that ``listing`` lacks, or get no
    payload are answered with an error.
    """
    parsed = parse_requests(lines.select(F.col("request").alias("__id"), "value"))
    valid, rejects = validate(parsed, allowed_dirs, max_bytes)
    if listing is not None:
        lost = missing_files(valid, "__id", listing)
        rejects = rejects.unionByName(valid.join(lost, "__id"))
        valid = valid.join(lost, "__id", "left_anti")
    asked = valid.select(F.col("__id").alias("request"), "value", F.col("request").alias("request_data"))
    payloads = answer(asked).select(F.col("request").alias("__id"), "payload")
    told = valid.join(payloads, "__id", "left")
    details = F.parse_json(F.lit("{}"))
    silent = F.struct(F.lit("ProcessingError").alias("type"), F.lit("The request gave no result").alias("message"), details.alias("details"))
    failed = rejects.select("__id", "request", "error").unionByName(told.where(F.col("payload").isNull()).select("__id", "request", silent.alias("error")))
    flat = lambda df: df.select("*", F.col("request.action").alias("action"), F.col("request.session_id").alias("session_id"))
    good = flat(told.where(F.col("payload").isNotNull())).select(
        F.col("__id").alias("request"), F.lit(True).alias("success"), success_response(F.col("action"), "session_id", F.col("payload"), at).alias("value"))
    bad = flat(failed).select(F.col("__id").alias("request"), F.lit(False).alias("success"), error_response("action", "session_id", "error", at=at).alias("value"))
    return good.unionByName(bad)


def serve(lines: DataFrame, folder: str, marks: str, answer: Callable[[DataFrame], DataFrame], **options):
    """Start answering a stream of request lines (value); see ``respond``.

    A request is identified by its file and the hash of its line, which stay the same when a batch is read again; equal lines of one file get equal
    responses, one each.  Each micro-batch's responses are one folder named after the batch, replaced as a whole if the batch is run again, so a restart
    after any failure gives each line one response.  Stops when all lines there are have been answered.
    """
    named = lines.select(F.concat_ws("#", F.col("_metadata.file_path"), F.sha2("value", 256)).alias("request"), "value")

    def batch(rows: DataFrame, batch_id: int) -> None:
        distinct = rows.groupBy("request").agg(F.first("value").alias("value"), F.count(F.lit(1)).cast("int").alias("copies")).persist()
        try:
            found = respond(distinct.select("request", "value"), answer, **options).join(distinct.select("request", "copies"), "request")
            each = found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(F.lit(batch_id).cast("bigint").alias("batch"), "request", "success", "value")
            each.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        finally:
            distinct.unpersist()

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", marks).trigger(availableNow=True).start()


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """All responses of the finished batches: batch, request, success, value."""
    done = [n for n in folder_names(spark, folder) if n.startswith("batch=") and "_SUCCESS" in folder_names(spark, f"{folder}/{n}")]
    empty = spark.createDataFrame([], RESPONSES)
    return spark.read.schema(RESPONSES).parquet(*[f"{folder}/{n}" for n in sorted(done)]) if done else empty
