"""Byte-level BPE encoding and decoding by a rank file: overlapping chunks, stitched where they agree.

A text longer than CHUNK characters is cut into chunks that overlap, and the chunks are dealt over all tasks.  Each is split
into pre-tokens from its own first character, which may stand inside one, and its pieces are encoded.  How a text is split
after a pre-token boundary depends only on what follows, so two neighbouring chunks agree from the first boundary that both
have in their overlap: there the ids of one end and those of the next begin.  A boundary close to a chunk's end, where
the splitting may have looked beyond it, does not count.  Each overlap is laid around the end of a run of letters,
digits or symbols, which is a boundary wherever the splitting began; a chunk grows until it meets one, so a common boundary always
exists.  A shorter text is one chunk and is encoded where it is.

A piece that is a token of the vocabulary is that token; in others the neighbours of the lowest rank merge, the leftmost first.  The new short
pieces of a batch merge together, one step of each at a time, as rows of a matrix; a long one by a heap, so that n bytes take n log n steps.  A
bounded memo keeps the ids of pieces.

Ids are packed: little-endian unsigned 32-bit integers in one binary value, as training data files hold them.  Decoding
joins the bytes of the ids; it gives back the text's bytes exactly.

Rules: null and empty texts have no ids (an empty binary).  Strings of special tokens are ordinary text.  Decoding null gives null;
ids outside the vocabulary, or a length that is no multiple of four, raise an error.  Equal rows give equal rows.  Result columns
replace columns of the same name; others pass through, the text excepted.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sheaf.llm.blobs import pack, unpack
from sheaf.llm.common import parts_for
from sheaf.llm.tables import written
from sheaf.llm.words import slices

CHUNK = 1 << 15  # characters
OVERLAP = 256  # characters on each side of the place that an overlap is laid around
MARGIN = 3  # a piece and the boundary at its end depend on at most so many characters from its end on
PART_BYTES = 8 << 20
BATCH_BYTES = 1 << 18  # texts split at a time
MEMO_PIECES = 500_000  # about 100 MB
ROW_BYTES = (8, 16, 32)  # widths of the matrices in which pieces merge
_NONE = np.iinfo(np.int64).max

# the end of a run of letters, of digits, or of symbols before white space always ends a pre-token
_RUN_END = r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=[^\s\p{L}\p{N}])\s"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of a piece: the pair of neighbours of the lowest rank merges, the leftmost first, until none has a rank."""
    n = len(piece)
    stop = list(range(1, n + 1))  # the end of the part that starts here; 0: none does
    before = list(range(-1, n))  # the start of the part before the one that starts here
    heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapify(heap)

    def offer(a: int, b: int, c: int) -> None:
        if c - a <= longest:
            rank = ranks.get(piece[a:c])
            if rank is not None:
                heappush(heap, (rank, a, b, c))

    while heap:
        _, a, b, c = heappop(heap)
        if stop[a] != b or stop[b] != c:
            continue  # one of the two has merged since
        stop[a], stop[b], before[c] = c, 0, a
        if before[a] >= 0:
            offer(before[a], a, c)
        if c < n:
            offer(a, c, stop[c])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : stop[at]]])
        at = stop[at]
    return ids


class Merges:
    """The merges of a vocabulary: which pairs of tokens make which token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest, self.base = ranks, max(map(len, ranks)), max(ranks.values()) + 1
        made = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    made[left * self.base + right] = rank
        self.keys = np.array(sorted(made), np.int64)
        self.made = np.array([*map(made.get, self.keys.tolist()), _NONE], np.int64)
        self.width_of = [next(w for w in ROW_BYTES if n <= w) for n in range(ROW_BYTES[-1] + 1)]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes; _NONE: no token."""
        wanted = left * self.base + right
        at = np.searchsorted(self.keys, wanted)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != wanted] = len(self.keys)
        return self.made[at]

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of two to ``width`` bytes."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        ids = self.of_byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)]
        inside = np.arange(1, width) < length[:, None]
        pair = np.full((n, width), _NONE)  # what each token makes with the next one; the last column makes nothing
        pair[:, :-1][inside] = self._made(ids[:, :-1][inside], ids[:, 1:][inside])
        out, rows, column = [b""] * n, np.arange(n), np.arange(width)
        while len(rows):
            at = pair.argmin(axis=1)
            token = np.take_along_axis(pair, at[:, None], 1)[:, 0]
            over = token == _NONE
            if over.any():
                packed = ids[over].astype("<u4").tobytes()
                for i, (row, k) in enumerate(zip(rows[over].tolist(), length[over].tolist())):
                    out[row] = packed[4 * width * i : 4 * (width * i + k)]
                ids, pair, rows, length, at, token = (x[~over] for x in (ids, pair, rows, length, at, token))
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = token
            # the token to the right is gone, and with it a column
            later = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, later, 1)
            pair = np.take_along_axis(pair, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            length = length - 1
            for side in (at - 1, at):  # the pairs that the new token is part of
                fits = (side >= 0) & (side + 1 < length)
                pair[each[fits], side[fits]] = self._made(ids[each[fits], side[fits]], ids[each[fits], side[fits] + 1])
            ends = at + 1 >= length
            pair[each[ends], at[ends]] = _NONE
        return out

    def packed(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of each piece."""
        out, rows, width_of, ranks = {}, {w: ([], []) for w in ROW_BYTES}, self.width_of, self.ranks
        for piece in pieces:
            raw = piece.encode()
            rank = ranks.get(raw)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(raw) < len(width_of):
                names, texts = rows[width_of[len(raw)]]
                names.append(piece)
                texts.append(raw)
            else:
                out[piece] = np.array(merge(raw, ranks, self.longest), "<u4").tobytes()
        for width, (names, texts) in rows.items():
            for lo in range(0, len(names), 1 << 14):
                out.update(zip(names[lo : lo + (1 << 14)], self.merge_rows(texts[lo : lo + (1 << 14)], width)))
        return out


class Codec:
    """A rank file and a splitting pattern, ready to encode."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.run_end = regex.compile(_RUN_END).search
        self.merges = Merges(read_ranks(path))
        self.known: dict[str, bytes] = {}

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, all of them in ``known``."""
        cut = [self.split(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cut))
        known = self.known
        new = [p for p in wanted if p not in known]
        if len(known) + len(new) > MEMO_PIECES:
            self.known, new = {}, list(wanted)
        self.known.update(self.merges.packed(new))
        return cut

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of whole texts."""
        cut = self.pieces(texts)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def chunks(self, text: str, size: int, overlap: int):
        """(start, end) of the overlapping chunks of a text."""
        start = 0
        while True:
            found = self.run_end(text, start + size)
            if found is None or found.start() + overlap >= len(text):
                yield start, len(text)
                return
            yield start, found.start() + overlap
            start = found.start() - overlap

    def encode_chunks(self, chunks: list[tuple[str, int, bool]], overlap: int) -> list[tuple[bytes, bytes]]:
        """For each chunk (text, start, last) its packed ids, and the boundaries near its ends: position in the text, ids of the chunk before it."""
        out = []
        for (text, start, last), pieces in zip(chunks, self.pieces([c[0] for c in chunks])):
            encoded = list(map(self.known.__getitem__, pieces))
            at = np.cumsum([0, *map(len, pieces)])
            ids = np.cumsum([0, *map(len, encoded)]) // 4
            head = at <= 2 * overlap
            tail = (at >= len(text) - 2 * overlap) & (at <= len(text) - MARGIN) & (not last)
            out.append((b"".join(encoded), pack(at[head] + start, ids[head], at[tail] + start, ids[tail])))
        return out


def stitch(encoded: list[tuple[bytes, bytes]]) -> bytes:
    """The ids of a text from its chunks in order: each takes over at the first boundary it shares with the one before."""
    out, begin, cuts = [], 0, [unpack(marks) for _, marks in encoded]
    for i, (ids, _) in enumerate(encoded):
        end, after = len(ids) // 4, 0
        if i + 1 < len(encoded):
            _, x, y = np.intersect1d(cuts[i][2], cuts[i + 1][0], return_indices=True)
            end, after = cuts[i][3][x[0]], cuts[i + 1][1][y[0]]
        out.append(ids[4 * begin : 4 * end])
        begin = after
    return b"".join(out)


def _encode_whole(path: str, pattern: str, column: str):
    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch, column, BATCH_BYTES):
                names = [n for n in part.schema.names if n != column]
                ids = codec.encode(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    return run


def _cut(path: str, pattern: str, size: int, overlap: int):
    """Rows (key, text, rest) → their chunks; the first carries the rest of the row."""

    def run(batches):
        codec = Codec(path, pattern)  # only its rule of where chunks end
        for batch in batches:
            kind = batch.schema.field("rest").type
            for i in range(batch.num_rows):
                key, text = batch.column("key")[i].as_py(), batch.column("text")[i].as_py()
                for at, (start, end) in enumerate(codec.chunks(text, size, overlap)):
                    rest = batch.column("rest").slice(i, 1) if at == 0 else pa.nulls(1, kind)
                    columns = [pa.array([key]), pa.array([at]), pa.array([start]), pa.array([end == len(text)]), pa.array([text[start:end]]), rest]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "start", "last", "text", "rest"])

    return run


def _encode_chunks(path: str, pattern: str, overlap: int):
    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                columns = (part.column(n).to_pylist() for n in ("text", "start", "last"))
                ids, marks = zip(*codec.encode_chunks(list(zip(*columns)), overlap))
                columns = [part.column("key"), part.column("at"), part.column("rest"), pa.array(ids, pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "rest", "chunk_ids", "marks"])

    return run


def _stitch():
    """The chunks of one text → its row."""

    def run(_, table):
        table = table.sort_by("at").combine_chunks()
        ids = stitch(list(zip(table.column("chunk_ids").to_pylist(), table.column("marks").to_pylist())))
        return pa.table({"rest": table.column("rest").slice(0, 1), "ids": pa.array([ids], pa.binary())})

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows without their text, with ``ids`` (packed) and ``n_tokens``.

    ``ranks``: path of a rank file, the same on all executors.  ``pattern``: a pattern of pre-tokens that covers every text, looks at most MARGIN
    characters ahead, and always ends a pre-token where a run of letters, digits, or symbols before white space ends.
    """
    if overlap < MARGIN or chunk < 4 * overlap:
        raise ValueError("a chunk must hold four overlaps, and an overlap the characters that splitting looks ahead")
    spark = docs.sparkSession
    docs = docs.drop("ids", "n_tokens")
    kept = [c for c in docs.columns if c != column]
    is_long = F.coalesce(F.length(column), F.lit(0)) > chunk
    fields = [docs.schema[c] for c in kept]
    short = docs.filter(~is_long).mapInArrow(_encode_whole(ranks, pattern, column), StructType([*fields, StructField("ids", BinaryType())]))
    # the key must stay with its row when a task runs again, so it is written before the chunks are dealt out
    rest = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = written(docs.filter(is_long).select(F.monotonically_increasing_id().alias("key"), F.col(column).alias("text"), rest.alias("rest")), "long-texts")
    rest_type = rows.schema["rest"]
    key = [StructField("key", LongType()), StructField("at", LongType())]
    chunks = rows.mapInArrow(_cut(ranks, pattern, chunk, overlap), StructType([*key, *StructType.fromDDL("start long, last boolean, text string").fields, rest_type]))
    parts = parts_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    encoded = chunks.repartition(parts, "key", "at").mapInArrow(
        _encode_chunks(ranks, pattern, overlap), StructType([*key, rest_type, *StructType.fromDDL("chunk_ids binary, marks binary").fields]))
    whole = encoded.groupBy("key").applyInArrow(_stitch(), StructType([rest_type, StructField("ids", BinaryType())]))
    long = whole.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(kept)], "ids")
    return short.union(long).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def _decode(path: str, column: str):
    def run(batches):
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        known = np.array([*map(bool, table), False])
        for batch in batches:
            out = []
            for packed in batch.column(column).to_pylist():
                ids = np.frombuffer(packed or b"", "<u4")
                if not known[np.minimum(ids, len(known) - 1)].all():
                    raise ValueError("an id stands for no token of the vocabulary")
                out.append(None if packed is None else b"".join(map(table.__getitem__, ids.tolist())))
            rest = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(out, pa.binary())], names=[*rest, "decoded"])

    return run


def decode(rows: DataFrame, ranks: str, column: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the bytes that the packed ids in ``column`` stand for."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decode(ranks, column), StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
