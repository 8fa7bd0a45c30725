"""Words and word hashes of whole Arrow batches, with numpy on the UTF-8 bytes.

A word is a maximal run of characters other than space and U+0009 to U+000D.  These are single
bytes in UTF-8, so words can be cut on the bytes.  A word's hash is 64 bits wide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_STEP = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_powers = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK_BYTES) + 1
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of several texts: byte positions in ``data`` and, by text, the words' offsets."""

    data: np.ndarray  # the bytes of all texts
    text_at: np.ndarray  # n texts + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n texts + 1 word offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        while lo < len(out):  # in runs of words, so that one huge text needs no huge arrays
            base = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, base + CHUNK_BYTES, side="right")))
            up, down = _power_tables(int(self.end[hi - 1]) - base + 1)
            part = self.data[base : self.end[hi - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_CODES[part] * up[: len(part)], out=sums[1:])
            a, b = self.start[lo:hi] - base, self.end[lo:hi] - base
            out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            lo = hi
        return out

    def kept_bytes(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """A text's words (those that ``keep`` marks) joined by one space."""
        a, b = self.first[text], self.first[text + 1]
        start, end = self.start[a:b], self.end[a:b]
        if keep is not None:
            start, end = start[keep], end[keep]
        if not len(start):
            return b""
        length = end - start
        # the byte after each word gives the place of the joining space
        out_at = np.concatenate(([0], np.cumsum(length + 1)))
        out = np.full(out_at[-1], 0x20, dtype=np.uint8)
        inside = np.ones(out_at[-1], dtype=bool)
        inside[out_at[1:] - 1] = False
        source = np.repeat(start - out_at[:-1], length + 1) + np.arange(out_at[-1])
        out[inside] = self.data[source[inside]]
        return out[:-1].tobytes()


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def cut(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` folds A to Z."""
    data, at = string_parts(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = _IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, across texts too; shorter than ``hashes`` by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _STEP[j]
    return mix(out)


def inside_text(first: np.ndarray, k: int) -> np.ndarray:
    """For each of the n - k + 1 runs of ``k`` words: whether one text holds all of it."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    change = np.zeros(n + 1, dtype=np.int64)
    start, stop = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(change, np.minimum(start, n), 1)
    np.add.at(change, np.minimum(stop, n), -1)
    return np.cumsum(change[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """The batch in runs of rows of about ``limit`` bytes of text each; a longer text stands alone."""
    _, at = string_parts(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
