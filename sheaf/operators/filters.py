"""Filters on paths and contents, all native column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import EXTENSION_GROUPS
from sheaf.functions.paths import extension
from sheaf.functions.patterns import ignored, pattern_forms, search_each
from sheaf.functions.text import is_text
from sheaf.operators.sizes import small_side
from sheaf.session import freeze

# Patterns that get a filter of their own; with more, each row's pattern is compiled for the row.
LITERAL_PATTERNS = 32


def drop_ignored(df: DataFrame, pattern: str | None = None, path: str = "path") -> DataFrame:
    """Drop rows whose path holds a match of the ignore pattern anywhere.

    ``pattern`` None or blank means the default list; an invalid one drops nothing.
    """
    hit = ignored(df.sparkSession, path, pattern)
    return df if hit is None else df.where(~hit)


def drop_ignored_by_session(
    df: DataFrame, settings: DataFrame, path: str = "path", key: str = "session_id", default: str | None = None
) -> DataFrame:
    """Drop rows whose path holds a match of their own session's ignore pattern.

    ``settings``: one row per session (``key``, ignore).  A blank pattern means the default list, an absent session ``default``; an invalid one drops nothing.  The
    distinct patterns are read once.  Those that Spark's engine surely reads as Python does are ``rlike`` filters, one for each while they
    are few; the others are searched by Python, on the paths of their sessions only.
    """
    raw = F.coalesce("ignore", F.lit("")).alias("ignore")
    forms = settings.select(raw).distinct().select("ignore", pattern_forms(F.col("ignore")).alias("form")).select("ignore", "form.*")
    chosen = freeze(settings.select(key, raw).join(forms, "ignore").select(key, "native", "python", F.lit(True).alias("known")))
    rest = [F.col(f"files.`{c}`") for c in df.columns]
    joined = df.alias("files").join(small_side(chosen).alias("chosen"), key, "left")
    native, python = F.col("chosen.native"), F.col("chosen.python")
    natives = [r[0] for r in chosen.select("native").where("native IS NOT NULL").distinct().limit(LITERAL_PATTERNS + 1).collect()]
    target = F.col(f"files.`{path}`")
    if len(natives) > LITERAL_PATTERNS:
        hit = F.coalesce(F.rlike(target, native), F.lit(False))
    else:
        hit = F.lit(False)
        for form in natives:
            hit = F.when(native == form, target.rlike(form)).otherwise(hit)
    otherwise = ignored(df.sparkSession, target, default)
    hit = F.coalesce(F.when(F.col("chosen.known"), hit).otherwise(F.lit(False) if otherwise is None else otherwise), F.lit(False))
    kept = joined.where(~hit & python.isNull()).select(*rest)
    if chosen.where("python IS NOT NULL").isEmpty():
        return kept
    # only these rows wait beside a Python worker
    by_python = joined.where(python.isNotNull()).where(~F.coalesce(search_each(target, python), F.lit(False)))
    return kept.union(by_python.select(*rest))


def drop_hidden(df: DataFrame, base: str, path: str = "path") -> DataFrame:
    """Drop rows with a component starting with a dot below ``base``."""
    rest = F.expr(f"substring({path}, {len(base.rstrip('/')) + 1})")
    return df.where(~F.contains(rest, F.lit("/.")))


def in_group(group: str, path: str = "path") -> Column:
    """True for files of a named extension group; every file belongs to ``All``."""
    if group == "All":
        return F.lit(True)
    return extension(path).isin(*EXTENSION_GROUPS[group])


def is_python(path: str = "path") -> Column:
    return F.col(path).endswith(".py")


def keep_text(df: DataFrame, content: str = "content", reference_strict: bool = False) -> DataFrame:
    return df.where(is_text(content, reference_strict))


def keep_python(
    df: DataFrame, path: str = "path", content: str = "content", reference_strict: bool = False
) -> DataFrame:
    """Python sources: the exact ending ``.py`` and text contents."""
    return df.where(is_python(path) & is_text(content, reference_strict))
