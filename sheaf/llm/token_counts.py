"""Token counts of whole texts by a public tokenizer.

Texts are cut before every space that stands before a character that is not white space; the byte-level pre-tokenizer
always cuts there, so the tokens of the segments are those of the text.  Each Arrow function
encodes the distinct segments it has not met yet, in batches balanced by bytes, and keeps only their
lengths.  The memo is bounded, and so is what one call holds, however long a text is.

Rules: null and empty texts have 0 bytes and 0 tokens.  No special tokens are added; the strings of
special tokens inside texts are handled as the library does by default.  Equal rows give equal rows.  Other columns pass
through, unless they have the name of a result column, which then replaces them.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import small_batches
from sheaf.llm.words import slices

BATCH_BYTES = 1 << 18
MEMO_SEGMENTS = 1_500_000  # about 200 MB

_UNSAFE = re.compile(r" (?=\s|$)")
_SAFE = re.compile(r" (?=\S)")


def segments(text: str) -> list[str]:
    """The text cut at the spaces that begin a token; those spaces are left out."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


def by_bytes(texts, limit: int = BATCH_BYTES):
    """Lists of texts of about ``limit`` characters each."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 8
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Lengths:
    """Token counts of segments, remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def learn(self, wanted: set[str]) -> None:
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > MEMO_SEGMENTS:
            self.known.clear()
            new = wanted
        for batch in by_bytes(new):
            for text, encoding in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                self.known[text] = len(encoding)

    def count(self, texts: list[str]) -> list[int]:
        # a segment's own text has its space again; the first segment of a text has none
        cut = [segments(t) if t else [] for t in texts]
        tails = set(chain.from_iterable(c[1:] for c in cut))
        spaced = {t: " " + t for t in tails}
        self.learn({c[0] for c in cut if c and c[0]} | set(spaced.values()))
        known = self.known
        lengths = {t: known[s] for t, s in spaced.items()}
        return [(known[c[0]] if c and c[0] else 0) + sum(map(lengths.__getitem__, c[1:])) for c in cut]


def _count(path: str, column: str):
    def run(batches):
        lengths = _Lengths(path)
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column).to_pylist()
                rest = [part.column(c) for c in part.schema.names if c != column]
                names = [c for c in part.schema.names if c != column]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lengths.count(texts), pa.int64())], names=[*names, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, column: str = "text") -> DataFrame:
    """The rows without their text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``tokenizer``: path of a byte-level BPE file of the ``tokenizers`` library, the same on all executors.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (column, "n_bytes", "n_tokens", "over_limit")]
    docs = docs.select(*keep, F.coalesce(F.octet_length(column), F.lit(0)).cast("long").alias("n_bytes"), F.col(column))
    fields = [f for f in docs.schema.fields if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return docs.mapInArrow(_count(tokenizer, column), schema).withColumn("over_limit", F.col("n_tokens") > limit)
