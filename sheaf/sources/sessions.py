"""Session records as JSON lines, and history states as JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema
from sheaf.constants import MODE_ALL
from sheaf.functions.times import iso_timestamp

KEEP_NULLS = {"ignoreNullFields": "false"}
_EMPTY = "array<string>"
_CORRUPT = "_corrupt"


def session_json(record: str | Column = "session") -> Column:
    """A session struct as one JSON text: keys in order, nulls kept, ISO times with offset."""

    def field(name):
        return F.col(f"{record}.{name}").alias(name)

    metadata = F.transform(
        F.col(f"{record}.file_metadata"),
        lambda m: m.withField("last_modified", iso_timestamp(m["last_modified"])),
    ).alias("file_metadata")
    return F.to_json(
        F.struct(
            field("id"),
            iso_timestamp(F.col(f"{record}.timestamp")).alias("timestamp"),
            field("files"),
            metadata,
            field("selection_state"),
            field("project_root"),
            field("tree_snapshot"),
            field("output_text"),
            F.coalesce(F.col(f"{record}.settings"), F.parse_json(F.lit("{}"))).alias("settings"),
        ),
        KEEP_NULLS,
    )


def parse_sessions(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(sessions, rejects) from JSON texts; required keys are checked, the others defaulted."""
    with_corrupt = T.StructType([*schema.SESSION.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.withColumn(
        "session",
        F.from_json(text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}),
    )
    s = "session"
    incomplete = F.exists(
        F.coalesce(f"{s}.file_metadata", F.array().cast(T.ArrayType(schema.FILE_METADATA))),
        lambda m: m["path"].isNull() | m["display_path"].isNull() | m["is_text_file"].isNull(),
    )
    problem = (
        F.when(F.col(s).isNull() | F.col(f"{s}.{_CORRUPT}").isNotNull(), F.lit("malformed"))
        .when(F.col(f"{s}.id").isNull(), F.lit("id"))
        .when(F.col(f"{s}.timestamp").isNull(), F.lit("timestamp"))
        .when(F.col(f"{s}.files").isNull(), F.lit("files"))
        .when(incomplete, F.lit("file_metadata"))
    )
    checked = parsed.withColumn("problem", problem)
    selection = F.struct(
        F.coalesce(f"{s}.selection_state.mode", F.lit(MODE_ALL)).alias("mode"),
        F.col(f"{s}.selection_state.selected_file").alias("selected_file"),
        F.coalesce(f"{s}.selection_state.selected_items", F.array().cast(_EMPTY)).alias("selected_items"),
    )
    filled = (
        F.col(s)
        .withField("selection_state", selection)
        .withField(
            "file_metadata", F.coalesce(f"{s}.file_metadata", F.array().cast(T.ArrayType(schema.FILE_METADATA)))
        )
        .withField("settings", F.coalesce(f"{s}.settings", F.parse_json(F.lit("{}"))))
        .dropFields(_CORRUPT)
    )
    good = checked.where(F.col("problem").isNull()).withColumn(s, filled).drop("problem")
    return good, checked.where(F.col("problem").isNotNull()).drop(s)


def write_sessions(sessions: DataFrame, path: str, record: str = "session") -> None:
    """One JSON record per line (indentation is not kept)."""
    sessions.select(session_json(record).alias("value")).write.text(path)


def read_sessions(spark: SparkSession, path: str, whole_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sessions from JSON lines, or, with ``whole_file``, one indented record per file."""
    return parse_sessions(spark.read.text(path, wholetext=whole_file))


# ---- history states ----


def write_states(states: DataFrame, path: str, key: str = "session_id", buckets: int = 256) -> None:
    """Append states as JSON lines that begin with their session, in folders by a hash of it.

    The number of folders does not grow with the sessions.  Rows are rebalanced by folder first: few files
    each, and a hot session is still split over many tasks.
    """
    others = [c for c in states.columns if c != key]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = states.select(key, *others).withColumn("timestamp", iso_timestamp("timestamp")).withColumn("bucket", bucket)
    rows.hint("rebalance", "bucket").write.mode("append").option("ignoreNullFields", "false").partitionBy("bucket").json(path)


def read_states(
    spark: SparkSession, path: str, key_type: str = "string", key: str = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """(states, broken): broken rows hold session_id and the text that is not a state.

    A state without an id is broken too.  The session of a broken line is read from its beginning, if it is there.
    """
    with_corrupt = T.StructType([*schema.STATE.fields, T.StructField(_CORRUPT, T.StringType())])
    begin = F.nullif(F.regexp_extract("value", rf'^\{{"{key}":"?([^",}}]*)', 1), F.lit(""))
    owner = F.coalesce(F.get_json_object("value", f"$.{key}"), begin)
    parsed = spark.read.text(path).withColumns(
        {
            "state": F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}),
            "session_id": owner.cast(key_type),
        }
    )
    broken = F.col("state").isNull() | F.col(f"state.{_CORRUPT}").isNotNull() | F.col("state.id").isNull()
    good = parsed.where(~broken).select("session_id", "state.*").drop(_CORRUPT)
    return good, parsed.where(broken).select("session_id", "value")
