"""Spark schemas of the data model."""

from pyspark.sql import types as T

_S = T.StringType()


def _f(name, dtype=_S, nullable=True):
    return T.StructField(name, dtype, nullable)


LISTING = T.StructType([
    _f("path", nullable=False),
    _f("parent"),
    _f("name"),
    _f("is_dir", T.BooleanType()),
    _f("length", T.LongType()),
    _f("mtime", T.TimestampType()),
    _f("error"),
])

FILES = T.StructType([
    _f("path", nullable=False),
    _f("content", T.BinaryType()),
    _f("mtime", T.TimestampType()),
    _f("length", T.LongType()),
    _f("error"),
])

FILE_METADATA = T.StructType([
    _f("path", nullable=False),
    _f("display_path", nullable=False),
    _f("is_text_file", T.BooleanType(), False),
    _f("language"),
    _f("last_modified", T.TimestampType()),
    _f("file_hash"),
    _f("size_bytes", T.LongType()),
])

TREE_SNAPSHOT = T.StructType([_f("base_path"), _f("base_path_display"), _f("ignore_regex"), _f("rendered")])

SELECTION_STATE = T.StructType([
    _f("mode"),
    _f("selected_file"),
    _f("selected_items", T.ArrayType(_S)),
])

SESSION = T.StructType([
    _f("id"),
    _f("timestamp", T.TimestampType()),
    _f("files", T.ArrayType(_S)),
    _f("file_metadata", T.ArrayType(FILE_METADATA)),
    _f("selection_state", SELECTION_STATE),
    _f("project_root"),
    _f("tree_snapshot", TREE_SNAPSHOT),
    _f("output_text"),
    _f("settings", T.VariantType()),
])

STATE = T.StructType([
    _f("id"),
    _f("timestamp", T.TimestampType()),
    _f("files", T.ArrayType(_S)),
    _f("selected_items", T.ArrayType(_S)),
    _f("selection_mode"),
    _f("selected_file"),
    _f("file_hashes", T.MapType(_S, _S)),
    _f("tree", TREE_SNAPSHOT),
])

REQUEST = T.StructType([
    _f("action"),
    _f("session_id"),
    _f("timestamp", T.TimestampType()),
    _f("payload", T.VariantType()),
])
