"""Text check, decoding, stripping, counting and hashing of file contents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.constants import HASH_ERROR, HASH_MISSING, LINE_BREAK_CHARS, SPACE_CHARS, TEXT_CHECK_BYTES


def _char_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


_NON_BLANK_LINE = f"[^{_char_class(SPACE_CHARS)}][^{_char_class(LINE_BREAK_CHARS)}]*+"
_NON_BLANK_COMMON = r"\S.*+"
# byte patterns without which a text has no white space but blank, tab, LF and CR
_RARE_SPACE = (
    b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f",
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(content, size: int = TEXT_CHECK_BYTES) -> Column:
    """The first bytes of a file."""
    return F.substring(_col(content), 1, size)


def is_text(content, reference_strict: bool = False) -> Column:
    """True when the head holds no NUL and is strict UTF-8; null content is not text.

    The head is cut at a fixed byte.  A multi-byte character crossing the cut is completed by up to
    three more bytes; ``reference_strict`` cuts it, so that the file counts as binary.
    """
    content = _col(content)
    first = head(content)

    def valid(size):
        return F.is_valid_utf8(head(content, size).cast("string"))

    ok = valid(TEXT_CHECK_BYTES)
    if not reference_strict:
        cut = F.octet_length(content) > TEXT_CHECK_BYTES
        ok = ok | (cut & (valid(TEXT_CHECK_BYTES + 1) | valid(TEXT_CHECK_BYTES + 2) | valid(TEXT_CHECK_BYTES + 3)))
    no_nul = ~F.contains(first, F.lit(bytearray(b"\x00")))
    return F.coalesce(no_nul & ok, F.lit(False))


def decode_text(content) -> Column:
    """UTF-8, else Latin-1 for the whole file; CRLF and CR become LF; a BOM stays."""
    content = _col(content)
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip(text) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(_col(text), F.lit(SPACE_CHARS))


def rstrip(text) -> Column:
    return F.rtrim(_col(text), F.lit(SPACE_CHARS))


def non_blank_lines(text) -> Column:
    """Number of lines with something other than white space.

    Every line break is white space, so one match begins at the first solid character of a
    line and runs to its end: one match per non-blank line, with no array of lines.  Texts
    without rare white space, told by byte searches, take a pattern the regex engine runs
    several times faster.
    """
    text = _col(text)
    raw = text.cast("binary")
    rare = reduce(or_, [F.contains(raw, F.lit(bytearray(b))) for b in _RARE_SPACE])
    lines = F.when(rare, F.regexp_count(text, F.lit(_NON_BLANK_LINE))).otherwise(
        F.regexp_count(text, F.lit(_NON_BLANK_COMMON))
    )
    return F.coalesce(lines, F.lit(0)).cast("bigint")


def content_hash(content, status=None) -> Column:
    """SHA-256 of the raw bytes; ``status`` 'missing' or 'error' gives the fixed marks."""
    digest = F.sha2(_col(content), 256)
    if status is None:
        return digest
    status = _col(status)
    return (
        F.when(status == "missing", F.lit(HASH_MISSING)).when(status == "error", F.lit(HASH_ERROR)).otherwise(digest)
    )
