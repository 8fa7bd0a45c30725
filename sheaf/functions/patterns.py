"""Ignore patterns: normal form, display form, validity and precedence of settings."""

from __future__ import annotations

import re
import warnings
from re import _parser  # Python's own reading of a pattern

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sheaf.constants import IGNORE_DEFAULT, SPACE_CHARS
from sheaf.functions.text import strip


def normalize_pattern(raw) -> Column:
    """Lines trimmed, blank ones dropped, the rest joined with ``|``."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    lines = F.transform(F.split(raw, r"\r\n|[\n\r]"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)))
    return F.array_join(F.filter(lines, lambda line: line != ""), "|")


def display_pattern(stored) -> Column:
    """One alternative per line (also inside groups of the pattern)."""
    stored = F.col(stored) if isinstance(stored, str) else stored
    return F.replace(stored, F.lit("|"), F.lit("\n"))


_PLAIN = re.UNICODE | re.DOTALL | re.VERBOSE  # flags that change nothing in what follows, or are handled


def _escaped(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:x}}}"


_SPACES = "".join(_escaped(ord(c)) for c in SPACE_CHARS)


class _NoForm(Exception):
    """A construct that Spark's engine lacks or reads differently."""


def _in_class(items) -> str:
    out, head = [], ""
    for kind, value in items:
        if kind is _parser.NEGATE:
            head = "^"
        elif kind is _parser.LITERAL:
            out.append(_escaped(value))
        elif kind is _parser.RANGE:
            out.append(f"{_escaped(value[0])}-{_escaped(value[1])}")
        elif kind is _parser.CATEGORY and value is _parser.CATEGORY_SPACE:
            out.append(_SPACES)
        elif kind is _parser.CATEGORY and value is _parser.CATEGORY_NOT_SPACE and len(items) == 1:
            head, out = "^", [_SPACES]
        else:  # digits and word characters follow each engine's own Unicode tables
            raise _NoForm
    return f"[{head}{''.join(out)}]"


def _sequence(items, any_char: str) -> str:
    return "".join(_item(kind, value, any_char) for kind, value in items)


def _item(kind, value, any_char: str) -> str:
    P = _parser
    if kind is P.LITERAL:
        return _escaped(value)
    if kind is P.NOT_LITERAL:
        return f"[^{_escaped(value)}]"
    if kind is P.ANY:
        return any_char
    if kind is P.IN:
        return _in_class(value)
    if kind is P.BRANCH:
        return f"(?:{'|'.join(_sequence(branch, any_char) for branch in value[1])})"
    if kind is P.SUBPATTERN and not value[1] and not value[2]:
        return f"(?:{_sequence(value[3], any_char)})"
    if kind is P.MAX_REPEAT or kind is P.MIN_REPEAT:
        least, most, inner = value
        upper = "" if most is P.MAXREPEAT else most
        return f"(?:{_sequence(inner, any_char)}){{{least},{upper}}}" + ("?" if kind is P.MIN_REPEAT else "")
    if kind is P.AT and value.name in _PLACES:
        return _PLACES[value.name]
    if kind is P.ASSERT or kind is P.ASSERT_NOT:
        sign = "=" if kind is P.ASSERT else "!"
        return f"(?{'<' if value[0] < 0 else ''}{sign}{_sequence(value[1], any_char)})"
    raise _NoForm


_PLACES = {"AT_BEGINNING": r"\A", "AT_BEGINNING_STRING": r"\A", "AT_END": r"(?=\n?\z)", "AT_END_STRING": r"\z"}


def native_form(pattern: str) -> str | None:
    """A pattern for Spark's engine that finds a match in exactly the texts in which ``pattern`` does in Python.

    None where there is no such form, or none that is sure: word characters, digits and their boundaries follow each engine's own
    Unicode tables; other letter cases, references to groups, conditional, atomic and possessive groups, and ``^`` and ``$`` at every line are
    left to Python.  ``pattern`` must be valid in Python, whose parser reads it.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # notes on classes that may one day be read as sets
        parsed = _parser.parse(pattern)
    if parsed.state.flags & ~_PLAIN:
        return None
    try:
        return _sequence(parsed, r"(?s:.)" if parsed.state.flags & re.DOTALL else r"[^\n]")
    except (_NoForm, ValueError):
        return None


def joined_pattern(raw: str | None) -> str:
    """The setting's lines as one pattern; unset or blank gives the default list."""
    text = IGNORE_DEFAULT if raw is None else raw
    lines = [line.strip() for line in text.splitlines()]
    return "|".join(line for line in lines if line) or IGNORE_DEFAULT


def python_pattern(raw: str | None) -> str | None:
    """The pattern for Python's engine; None, "ignore nothing", for one that Python refuses."""
    joined = joined_pattern(raw)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(joined)
    except (re.error, RecursionError, OverflowError):
        return None
    return joined


def effective_pattern(spark: SparkSession, raw: str | None) -> str | None:
    """The pattern that ``rlike`` may use; None means "ignore nothing".

    Unset or blank gives the default list (blank is documented as "restore defaults").  Python decides
    what is valid; an invalid pattern ignores nothing.  A valid one without a sure form for Spark's engine is
    an error; ``ignored`` takes those too.
    """
    joined = python_pattern(raw)
    if joined is None:
        return None
    java = native_form(joined)
    if java is None or not is_valid_pattern(spark, java):
        raise ValueError(f"Spark's engine has no form of the pattern {joined!r}")
    return java


def _searches(texts: pa.Array, pattern: str) -> pa.Array:
    found = re.compile(pattern).search
    return pa.array([None if t is None else found(t) is not None for t in texts.to_pylist()], pa.bool_())


def search_python(text: Column, pattern: str) -> Column:
    """Whether Python's engine finds the pattern: an Arrow function over the texts alone."""
    return F.arrow_udf(lambda texts: _searches(texts, pattern), "boolean")(text)


def search_any(lists: pa.Array, pattern: str) -> pa.Array:
    """For each list of texts, whether Python's engine finds the pattern in one of them."""
    found = re.compile(pattern).search
    return pa.array([any(found(t) for t in texts or ()) for texts in lists.to_pylist()], pa.bool_())


def ignored(spark: SparkSession, text, raw: str | None) -> Column | None:
    """Whether the setting's pattern is found in the text; None means "ignore nothing".

    Spark's engine does it wherever it surely agrees with Python's, else Python's.
    """
    text = F.col(text) if isinstance(text, str) else text
    try:
        java = effective_pattern(spark, raw)
    except ValueError:
        return search_python(text, python_pattern(raw))
    return None if java is None else text.rlike(java)


def search_each(text: Column, pattern: Column) -> Column:
    """As ``search_python``, each row with its own pattern; null without one."""

    def search(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), patterns.to_pylist())  # re keeps the patterns compiled last
        return pa.array([None if t is None or p is None else re.search(p, t) is not None for t, p in rows], pa.bool_())

    return F.arrow_udf(search, "boolean")(text, pattern)


def pattern_forms(raw: Column) -> Column:
    """struct(native, python) of a setting: the form for Spark's engine, else the pattern for Python's; both null: ignores nothing."""

    def forms(settings: pa.Array) -> pa.Array:
        rows = []
        for joined in map(python_pattern, settings.to_pylist()):
            native = None if joined is None else native_form(joined)
            rows.append({"native": native, "python": joined if native is None else None})
        return pa.array(rows, pa.struct([("native", pa.string()), ("python", pa.string())]))

    return F.arrow_udf(forms, "struct<native:string,python:string>")(raw)


def matches_any_extension(pattern: str) -> bool:
    """True when a match in a text surely is one in every longer text that starts with it.

    Patterns (as Python reads them) of plain characters, dots, alternatives and simple repeats qualify: they cannot
    look at where the text ends.
    """
    return re.fullmatch(r"[\w\s|./+*\-@#%&=~,:;]*", pattern) is not None


def is_valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Let Spark's own engine judge the pattern; constant folding makes this a driver-side check."""
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
        return True
    except PySparkException:
        return False


def first_non_blank(*candidates) -> Column:
    """The first setting that is neither null nor blank, trimmed."""
    cols = [F.col(c) if isinstance(c, str) else c for c in candidates]
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])
