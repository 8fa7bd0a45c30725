"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds the pieces of a public model.  It is run once over a chunk; at each position it reports every piece that
ends there (its output links), and each relaxes the best score at that position from the score where it starts.  A character that
no piece holds costs UNKNOWN below the worst piece and is written as its UTF-8 byte pieces.  Pieces hold the space mark only at
their start, so texts are cut before each run of spaces, the chunks of a batch are encoded once each, and a bounded memo
keeps their pieces.  The segmentation is the one of highest total score, as in the library's unigram inference over these
pieces; a model made for merges may cut some words otherwise with the library.

Spaces become the mark and one is put before the text.  A mark that stands in the text itself is written as byte pieces, so
decoding always gives back the text exactly.

Rules: a null text has null pieces, an empty one none.  Decoding null gives null; ids outside the model raise an error.
Repeated rows get equal pieces.  Result columns replace columns of the same name; others pass through.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import small_batches
from sheaf.llm.words import slices

MEMO_CHUNKS = 1_000_000  # about 150 MB
UNKNOWN = 10.0
MARK = "▁"

_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class Codec:
    """Pieces of a model, ready to encode and decode."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.lengths, self.texts, self.bytes = [], [], {}
        worst = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.lengths.append(len(piece))
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                worst = min(worst, model.get_score(i))
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                self.texts.append(piece.replace(MARK, " ").encode())
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN
        self.known: dict[str, bytes] = {}

    def _byte_ids(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()]

    def segment(self, chunk: str) -> list[int]:
        """The ids of the chunk's best segmentation."""
        n = len(chunk)
        best, via = [0.0] * (n + 1), [-1] * (n + 1)
        done, unknown = 0, self.unknown
        for last, (length, score, piece) in self.automaton.iter(chunk):
            end = last + 1
            while done < end:  # first by an unknown character
                done += 1
                best[done] = best[done - 1] + unknown
            total = best[end - length] + score
            if total > best[end]:
                best[end], via[end] = total, piece
        ids, at = [], n
        while at > 0:
            piece = via[at] if at <= done else -1
            if piece < 0:
                ids.extend(reversed(self._byte_ids(chunk[at - 1])))
                at -= 1
            else:
                ids.append(piece)
                at -= self.lengths[piece]
        return ids[::-1]

    def _chunks(self, text: str) -> list[str]:
        """The marked text in chunks; an empty chunk stands for a mark of the text itself."""
        first, *rest = text.split(MARK)
        found = _CHUNKS.findall(MARK + first.replace(" ", MARK))
        for part in rest:
            found.append("")  # a literal mark
            found.extend(_CHUNKS.findall(part.replace(" ", MARK)))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Each text's ids as 32-bit integers."""
        cut = [self._chunks(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cut))
        if len(self.known) + len(wanted) > MEMO_CHUNKS:
            self.known.clear()
        for chunk in wanted - self.known.keys():
            ids = self.segment(chunk) if chunk else self._byte_ids(MARK)
            self.known[chunk] = np.array(ids, dtype=np.int32).tobytes()
        known = self.known.__getitem__
        return [None if t is None else b"".join(map(known, c)) for t, c in zip(texts, cut)]

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        out = b"".join(map(self.texts.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode()


def _lists(encoded: list[bytes | None]) -> pa.Array:
    flat = np.frombuffer(b"".join(e or b"" for e in encoded), dtype=np.int32)
    at = np.concatenate(([0], np.cumsum([len(e or b"") // 4 for e in encoded]))).astype(np.int32)
    none = np.array([e is None for e in encoded], dtype=bool)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=pa.array(none))


def _encode(path: str, names: list[str], verify: bool):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                encoded = codec.encode(texts)
                columns, more = [part.column(n) for n in names] + [_lists(encoded)], ["ids"]
                if verify:
                    same = [None if t is None else codec.decode(np.frombuffer(e, np.int32).tolist()) == t for t, e in zip(texts, encoded)]
                    columns, more = [*columns, pa.array(same, pa.bool_())], ["ids", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *more])

    return run


def _schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in names)


def encode(docs: DataFrame, model: str, verify: bool = False) -> DataFrame:
    """The rows with ``ids`` (array<int>); with ``verify`` also round_trip: whether decoding gives the text back.

    ``model``: path of a SentencePiece model, the same on all executors.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", *(["round_trip"] if verify else []))
    schema = _schema(docs, docs.columns) + "ids array<int>" + (", round_trip boolean" if verify else "")
    return docs.mapInArrow(_encode(model, docs.columns, verify), schema)


def _decode(path: str, names: list[str], column: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return run


def decode(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the text of the ids in ``column``."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decode(model, rows.columns, column), _schema(rows, rows.columns) + "decoded string")


def with_counts(encoded: DataFrame) -> DataFrame:
    """Adds n_pieces; null for a null text."""
    return encoded.withColumn("n_pieces", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))
