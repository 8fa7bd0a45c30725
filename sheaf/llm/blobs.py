"""Integer arrays as compressed blobs: what the numpy operators send through Spark's shuffles."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = "uint8 uint32 uint64 int64 float32 float64".split()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays → one blob; the n-th bytes of all numbers stand together, so empty high bytes cost nothing."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<BQ", _KINDS.index(a.dtype.name), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob) -> list[np.ndarray]:
    """The arrays of a blob."""
    blob = bytes(blob)
    n, at, shapes = blob[0], 1, []
    for _ in range(n):
        kind, length = struct.unpack_from("<BQ", blob, at)
        shapes.append((np.dtype(_KINDS[kind]), length))
        at += 9
    body = zstandard.ZstdDecompressor().decompress(blob[at:])
    out, at = [], 0
    for kind, length in shapes:
        size = kind.itemsize * length
        part = np.frombuffer(body, np.uint8, size, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(length))
        at += size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first value first; undone by ``np.cumsum`` in the same kind."""
    return np.diff(a, prepend=a.dtype.type(0))
