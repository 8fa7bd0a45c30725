"""File-open events as a stream: each replaces its session's selection and makes a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sheaf.operators.history import open_events
from sheaf.streaming.replay import replay_stream


def intake_stream(opened: DataFrame) -> DataFrame:
    """Change log of the histories made by file-open events (session_id, seq, path)."""
    return replay_stream(open_events(opened))
