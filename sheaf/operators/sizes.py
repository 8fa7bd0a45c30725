"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import BROADCAST_BYTES


def text_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small; else unmarked, for a shuffled join.

    ``df`` is evaluated for the check, so it should be frozen or cheap.
    """
    return F.broadcast(df) if text_bytes(df) <= limit else df
