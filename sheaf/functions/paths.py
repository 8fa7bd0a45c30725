"""Path arithmetic on strings: names, languages, display forms, ancestors, common paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.constants import LANGUAGE_BY_SUFFIX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path) -> Column:
    """The path without its last component; ``/`` for a top-level entry."""
    path = _col(path)
    cut = path.substr(F.lit(1), F.length(path) - F.length(basename(path)) - 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def suffix(path) -> Column:
    """The last suffix with its dot, lower-cased; empty for ``.bashrc`` or ``Makefile``."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]([.][^.]+)\z", 1))


def extension(path) -> Column:
    """The text after the last dot of the name, as written."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def language(path) -> Column:
    """The Markdown fence language of a file, by suffix; empty where unknown."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(LANGUAGE_BY_SUFFIX.items())])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(""))


def under(path, base) -> Column:
    """True when ``path`` is ``base`` or lies below it, by whole components."""
    path, base = _col(path), _col(base)
    return (path == base) | F.startswith(path, F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))


def relative(path, base) -> Column:
    """The part of ``path`` below ``base``; empty when they are equal."""
    path, base = _col(path), _col(base)
    return F.when(path == base, F.lit("")).otherwise(
        path.substr(F.length(F.rtrim(base, F.lit("/"))) + 2, F.length(path))
    )


def components(rel) -> Column:
    """Components of a relative path; an empty path has none."""
    rel = _col(rel)
    return F.when(rel == "", F.array().cast("array<string>")).otherwise(F.split(rel, "/"))


def display_path(path, root, home, show_ellipsis: bool = False) -> Column:
    """A path as shown to the reader: ``~/…`` below home, else absolute.

    ``root`` may be null.  Below a root that is itself below home, the root part is
    shortened to first/…/last when ellipsis is on and it has more than two components;
    otherwise a path of more than five components keeps its two ends.
    """
    path, root = _col(path), _col(root)
    home = F.lit(home) if isinstance(home, str) else home
    root_text, rel_text = relative(root, home), relative(path, home)
    if show_ellipsis:
        root_text = F.regexp_replace(root_text, r"(?s)\A([^/]+)/.+/([^/]+)\z", "$1/…/$2")
        rel_text = F.regexp_replace(rel_text, r"(?s)\A([^/]+/[^/]+)/[^/]+/.+/([^/]+/[^/]+)\z", "$1/…/$2")
    in_root = F.coalesce(under(path, root) & under(root, home), F.lit(False))
    return (
        F.when(~under(path, home), path)
        .when(in_root, F.concat(F.lit("~/"), root_text, F.lit("/"), relative(path, root)))
        .when(path == home, F.lit("~/."))
        .otherwise(F.concat(F.lit("~/"), rel_text))
    )


def ancestors(path) -> Column:
    """The path itself and every directory above it, from ``/`` down."""
    parts = F.split(_col(path), "/")
    n = F.when(_col(path) == "/", F.lit(1)).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )


def common_path(path) -> Column:
    """Aggregate: the deepest directory (or file) all paths share, by components.

    Smallest and largest component array agree exactly as far as all of them do, so two
    partial aggregates are enough and no group is collected.
    """
    parts = F.split(_col(path), "/")
    low, high = F.min(parts), F.max(parts)
    first_difference = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    shared = F.when(first_difference == 0, F.size(low)).otherwise(first_difference - 1).cast("int")
    joined = F.array_join(F.slice(low, F.lit(1), F.greatest(shared, F.lit(1))), "/")
    return F.when(low.isNull(), F.lit(None)).when(joined == "", F.lit("/")).otherwise(joined)
