"""Time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(ts) -> Column:
    """ISO-8601 with offset; the fraction is left out when it is zero."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(exact)


def modified_line(mtime, machine_readable: bool = False) -> Column:
    """The "Last modified" line of a block; ``?`` where the time is unknown."""
    mtime = F.col(mtime) if isinstance(mtime, str) else mtime
    shown = iso_timestamp(mtime) if machine_readable else F.date_format(mtime, "MMM dd, yyyy hh:mm a z")
    return F.concat(F.lit("**Last modified: "), F.coalesce(shown, F.lit("?")), F.lit("**"))
