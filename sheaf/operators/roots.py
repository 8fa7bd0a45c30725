"""Common directory and project root of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.constants import IGNORE_DEFAULT, PROJECT_MARKERS
from sheaf.functions.paths import ancestors, basename, common_path, parent, under
from sheaf.functions.patterns import first_non_blank


def common_paths(selection: DataFrame) -> DataFrame:
    """(session_id, common): the deepest path all files of the session share."""
    return selection.groupBy("session_id").agg(common_path("path").alias("common"))


def marker_dirs(listing: DataFrame, markers: tuple[str, ...] = PROJECT_MARKERS) -> DataFrame:
    """Directories that directly hold a project marker (hidden ones and directories count)."""
    return listing.where(basename("path").isin(*markers)).select(parent("path").alias("ancestor")).distinct()


def project_roots(selection: DataFrame, markers: DataFrame, home: str) -> DataFrame:
    """(session_id, common, root): nearest directory with a marker, from the common path up.

    The climb stops after home (or ``/``); with no marker the common path is the root.  Only
    a session's few ancestors are joined, whatever its number of files.
    """
    common = common_paths(selection)
    climb = common.select("session_id", F.explode(ancestors("common")).alias("ancestor"), "common")
    in_reach = ~under("common", F.lit(home)) | under("ancestor", F.lit(home))
    hits = (
        climb.where(in_reach)
        .join(markers, "ancestor", "left_semi")
        .groupBy("session_id")
        .agg(F.max_by("ancestor", F.length("ancestor")).alias("root"))
    )
    return common.join(hits, "session_id", "left").select(
        "session_id", "common", F.coalesce("root", "common").alias("root")
    )


def tree_base(window_base, root, default_base, common):
    """Which directory a tree starts from: the first non-blank of the four settings."""
    return first_non_blank(window_base, root, default_base, common)


def folder_base(base, is_file):
    """A base that is a file means its folder."""
    base = F.col(base) if isinstance(base, str) else base
    return F.when(F.coalesce(F.col(is_file) if isinstance(is_file, str) else is_file, F.lit(False)), parent(base)).otherwise(base)


def ignore_setting(window_ignore, shared_ignore):
    """The window's pattern, else the shared one, else the default list."""
    return F.coalesce(first_non_blank(window_ignore, shared_ignore), F.lit(IGNORE_DEFAULT))


def effective_root(window_base, root):
    """A locked tree base also overrides the project root."""
    return first_non_blank(window_base, root)
