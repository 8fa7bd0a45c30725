"""Validation of requests: the good ones go on, the others carry an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import ACTIONS, BAD_PATH, BAD_SESSION_ID, FILE_NOT_FOUND
from sheaf.functions.paths import under

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
_STRINGS = "array<string>"


def payload_field(name: str, dtype: str = "string", request: str = "request") -> Column:
    return F.try_variant_get(F.col(f"{request}.payload"), f"$.{name}", dtype)


def request_paths(request: str = "request") -> Column:
    """All file paths a request names."""
    one = payload_field("file_path", request=request)
    return F.concat(
        F.coalesce(payload_field("files", _STRINGS, request), F.array().cast(_STRINGS)),
        F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(_STRINGS)),
    )


def _error(kind: str, message, field: str, expected: str, received) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    details = F.struct(F.lit(field).alias("field"), F.lit(expected).alias("expected"), received.alias("received"))
    return F.struct(F.lit(kind).alias("type"), message.alias("message"), _variant(details).alias("details"))


def _variant(value: Column) -> Column:
    """A struct as VARIANT, so that errors of different kinds are of one type and print as objects."""
    return F.parse_json(F.to_json(value, {"ignoreNullFields": "false"}))


def shape_error(allowed_dirs: list[str] | None = None, max_bytes: int | None = None, text: str = "value") -> Column:
    """The first thing wrong with a request's own text, or null: struct(type, message, details as VARIANT)."""
    action, session = F.col("request.action"), F.col("request.session_id")
    paths = request_paths()
    first_bad = {
        "absolute": F.filter(paths, lambda p: ~F.startswith(p, F.lit("/"))),
        "traversal": F.filter(paths, lambda p: F.array_contains(F.split(p, "/"), "..")),
    }
    missing = (
        F.when((action == "process_files") | (action == "get_python_symbols"), payload_field("files", _STRINGS).isNull())
        .when(action == "update_selection", payload_field("selection_state", "variant").isNull())
        .otherwise(payload_field("file_path").isNull())
    )
    required = (
        F.when((action == "process_files") | (action == "get_python_symbols"), F.lit("files"))
        .when(action == "update_selection", F.lit("selection_state"))
        .otherwise(F.lit("file_path"))
    )
    malformed = F.col("request").isNull() | (action.isNull() & session.isNull() & F.col("request.payload").isNull())
    kind = "ValidationError"
    rules = F.when(
        malformed, _error(kind, "Malformed JSON request", "request", "One JSON object per line", F.col(text))
    )
    if max_bytes is not None:
        rules = rules.when(
            F.octet_length(text) > max_bytes,
            _error(kind, "Request is too large", "request", f"At most {max_bytes} bytes", F.octet_length(text).cast("string")),
        )
    rules = (
        rules.when(
            action.isNull() | ~action.isin(*ACTIONS),
            _error(kind, "Unknown action", "action", ", ".join(ACTIONS), action),
        )
        .when(
            session.isNull() | ~session.rlike(_UUID),
            _error(BAD_SESSION_ID[0], BAD_SESSION_ID[1], "session_id", BAD_SESSION_ID[2], session),
        )
        .when(missing, _error(kind, F.concat(F.lit("Missing payload field "), required), "payload", "Required fields", required))
        .when(
            F.size(first_bad["absolute"]) > 0,
            _error(kind, BAD_PATH, "path", "Absolute path", F.get(first_bad["absolute"], F.lit(0))),
        )
        .when(
            F.size(first_bad["traversal"]) > 0,
            _error(kind, BAD_PATH, "path", "No parent references", F.get(first_bad["traversal"], F.lit(0))),
        )
    )
    if allowed_dirs:
        outside = F.filter(paths, lambda p: ~_any([under(p, F.lit(d)) for d in allowed_dirs]))
        rules = rules.when(
            F.size(outside) > 0,
            _error("PermissionError", "Path outside allowed directories", "path", ", ".join(allowed_dirs), F.get(outside, F.lit(0))),
        )
    return rules


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def validate(
    requests: DataFrame, allowed_dirs: list[str] | None = None, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) by shape; rejects carry ``error``."""
    checked = requests.withColumn("error", shape_error(allowed_dirs, max_bytes))
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def split_by_existence(requests: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """One row per (request, file): key, path, accessible."""
    files = requests.select(key, F.explode(request_paths()).alias("path"))
    there = listing.where(~F.col("is_dir")).select("path").distinct().withColumn("__there", F.lit(True))
    return files.join(there, "path", "left").select(
        key, "path", F.coalesce("__there", F.lit(False)).alias("accessible")
    )


def missing_files(requests: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """Requests naming files that do not exist: key, error with missing and accessible files.

    The lists hold at most what one request record itself held.
    """
    split = split_by_existence(requests, key, listing)
    listed = split.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(~F.col("accessible"), F.col("path")))).alias("missing_files"),
        F.array_sort(F.collect_list(F.when(F.col("accessible"), F.col("path")))).alias("accessible_files"),
    )
    return listed.where(F.size("missing_files") > 0).select(
        key,
        F.struct(
            F.lit(FILE_NOT_FOUND[0]).alias("type"),
            F.lit(FILE_NOT_FOUND[1]).alias("message"),
            _variant(F.struct("missing_files", "accessible_files")).alias("details"),
        ).alias("error"),
    )
