"""Requests in and responses out, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import schema


def parse_requests(lines: DataFrame, text: str = "value") -> DataFrame:
    """Add ``request``: the envelope of one JSON line; null fields where it is malformed."""
    return lines.withColumn("request", F.from_json(text, schema.REQUEST))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_requests(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def _stamp(at) -> list[Column]:
    """The time of a response, where one is given."""
    return [] if at is None else [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")]


def success_response(action, session_id, payload, at: Column | None = None) -> Column:
    """One response line; ``payload`` is a struct, ``at`` the time of the response (UTC)."""
    return F.to_json(
        F.struct(
            F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"),
            F.col(session_id).alias("session_id"),
            *_stamp(at),
            F.lit(True).alias("success"),
            payload.alias("payload"),
        ),
        {"ignoreNullFields": "false"},
    )


def error_response(action, session_id, error: str, debug: bool = False, at: Column | None = None) -> Column:
    """One error line from an error struct (type, message, details and, on request, debug)."""
    fields = [F.col(f"{error}.{n}").alias(n) for n in ("type", "message", "details")]
    if debug:
        fields.append(F.col(f"{error}.debug").alias("debug"))
    return F.to_json(
        F.struct(
            F.col(action).alias("action"),
            F.col(session_id).alias("session_id"),
            *_stamp(at),
            F.lit(False).alias("success"),
            F.struct(*fields).alias("error"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).alias("value")).write.mode("append").text(path)
