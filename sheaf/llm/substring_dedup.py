"""Substring dedup: remove words covered by a window of words that also starts earlier.

Level-wise doubling.  All windows of half the length asked are hashed; only where two windows that
follow each other both occur more than once, the window of twice the length is a candidate, and its
identity follows from the classes of its two halves, without the text.  Each level is one exchange by
hash (which windows repeat?) and one by source (which windows follow each other?).  ``levels``
gives how often the length doubles; the last level has the length asked.  Longer windows than that
cannot remove more words, so removal ends there; ``repeated_lengths`` goes on until no candidates survive.

A source is some MB of texts of one input partition.  It sends each distinct window once, so a
window that fills a third of all texts costs one entry for each source.  Windows are told apart by KEPT bits of
their hashes, and on the last level by the 56 lowest beside those of their bucket.

Rules: a null or empty text has no words.  A null ``doc_id`` counts as the largest.  Rows with the
same ``doc_id`` are the same document: of two equal windows at the same start, neither is removed.
Texts shorter than the window are kept.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, steps, unpack
from sheaf.llm.common import parts_for, small_batches, text_bytes
from sheaf.llm.tables import written
from sheaf.llm.words import cut, grams, inside_text, mix, slices

SOURCE_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
KEPT = 56

_LAST = np.int64(2**63 - 1)  # stands for a null doc_id
_HASHES, _REPEATS, _DOCS, _CLASSES, _FLAGS, _TIES, _FOUND, _TEXTS, _CUTS = range(9)
_MESSAGE = "to long, source long, kind int, blob binary"
_ARROW = pa.schema([("to", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:long,last:long>>"


class _Out:
    """Messages collected for one Arrow batch."""

    def __init__(self):
        self.rows = [[], [], [], []]

    def add(self, to, source, kind, blob):
        for column, value in zip(self.rows, (to, source, kind, blob)):
            column.append(value)

    def table(self) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(self.rows, _ARROW)], schema=_ARROW)


def _messages(table: pa.Table):
    """(source, kind, arrays) of each message."""
    for source, kind, blob in zip(*(table.column(c).to_pylist() for c in ("source", "kind", "blob"))):
        yield source, kind, unpack(blob)


def _home(source: int, parts: int) -> int:
    return hash(source) % parts


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def _hash_texts(length: int, parts: int):
    """Texts → for each source: its distinct window hashes by bucket, local repeats, documents."""

    def send(out: _Out, source: int, ids, keys, counts, hashes):
        first = np.concatenate(([0], np.cumsum(counts)))
        out.add(_home(source, parts), source, _DOCS, pack(ids, keys, counts))
        at = np.flatnonzero(inside_text(first, length))
        _send_distinct(out, source, parts, at, grams(hashes, length)[at])

    def run(batches):
        place, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            out = _Out()
            send(out, (place << 32) + number, *(np.concatenate(c) for c in zip(*held)))
            number, held, size = number + 1, [], 0
            return out.table().to_batches()

        for batch in batches:
            for part in slices(batch):
                words = cut(part.column("text"))
                held.append((_ids(part.column("doc_id")), part.column("key").to_numpy(), words.counts, words.hashes()))
                size += len(words.data)
                if size >= SOURCE_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _repeated(parts: int):
    """In a bucket: a class number for each window hash that occurs more than once."""

    def run(key, table):
        out, bucket = _Out(), key[0].as_py()
        sources, found = [], []
        for source, kind, arrays in _messages(table):
            if kind != _HASHES:
                out.add(_home(source, parts), source, kind, pack(*arrays))
            else:
                sources.append(source)
                found.append((np.cumsum(arrays[0]), arrays[1], arrays[2]))
        if found:
            value, where, again = (np.concatenate(c) for c in zip(*found))
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            del found
            order = np.argsort(value, kind="stable")
            value = value[order]
            head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            total = np.add.reduceat(again[order].astype(np.int64) + 1, head)
            kept = total > 1
            number = np.where(kept, np.cumsum(kept) * parts + bucket, 0)  # 0: occurs once
            of = np.empty(len(order), dtype=np.uint64)
            of[order] = np.repeat(number, np.diff(np.append(head, len(order)))).astype(np.uint64)
            edges = np.searchsorted(row, np.arange(len(sources) + 1))
            for i, source in enumerate(sources):
                own = of[edges[i] : edges[i + 1]]
                at = where[edges[i] : edges[i + 1]][own > 0]
                sort = np.argsort(at)
                if len(at):
                    out.add(_home(source, parts), source, _CLASSES, pack(steps(at[sort]), own[own > 0][sort]))
        return out.table()

    return run


def _classes_of(n: int, classes, repeats) -> np.ndarray:
    """The class of the window at each word; 0 where it occurs once."""
    of = np.zeros(n, dtype=np.uint64)
    for at, number in classes:
        of[np.cumsum(at)] = number
    for at, like in repeats:
        of[np.cumsum(at)] = of[like]
    return of


def _double(half: int, last: bool, parts: int):
    """At a source: candidates of twice the length; sent on to their buckets, documents kept."""

    def run(key, table):
        out, source = _Out(), key[0].as_py()
        got = {kind: [] for kind in range(9)}
        for _, kind, arrays in _messages(table):
            got[kind].append(arrays)
        ids, keys, counts = got[_DOCS][0]
        first = np.concatenate(([0], np.cumsum(counts)))
        n = int(first[-1])
        out.add(_home(source, parts), source, _DOCS, pack(ids, keys, counts))
        of = _classes_of(n, got[_CLASSES], got[_REPEATS])
        at = np.flatnonzero(inside_text(first, 2 * half))
        at = at[(of[at] > 0) & (of[at + half] > 0)]
        value = mix(mix(of[at]) * np.uint64(3) + of[at + half])
        if last:
            _send_firsts(out, source, parts, ids, first, at, value, n)
        else:
            _send_distinct(out, source, parts, at, value)
        return out.table()

    return run


def _buckets(value: np.ndarray, parts: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes: buckets are ranges of hashes."""
    return np.searchsorted((value >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64))


def _send_distinct(out, source, parts, at, value):
    """Each distinct hash once, to its bucket; the places of local repeats stay.

    Hashes are sorted, so the steps between the KEPT bits that are sent are small numbers.
    """
    value, index, inverse, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    where, again = at[index], count > 1
    local = again[inverse]
    if local.any():
        out.add(_home(source, parts), source, _REPEATS, pack(steps(at[local]), where[inverse[local]].astype(np.uint32)))
    edges, rest = _buckets(value, parts), value >> np.uint64(64 - KEPT)
    for b in np.flatnonzero(np.diff(edges)):
        a, z = edges[b], edges[b + 1]
        out.add(int(b), source, _HASHES, pack(steps(rest[a:z]), where[a:z].astype(np.uint32), again[a:z].astype(np.uint8)))


def _send_firsts(out, source, parts, ids, first, at, value, n):
    """The last level: the earliest window of each value goes on, later ones are flagged here."""
    doc = np.searchsorted(first, at, side="right") - 1
    start, owner = at - first[doc], ids[doc]
    order = np.lexsort((start, owner, value))
    at, value, start, owner = at[order], value[order], start[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = (owner != owner[head][group]) | (start != start[head][group]) if len(head) else new
    flags = np.zeros(n, dtype=np.uint8)
    flags[at[later]] = 1
    out.add(_home(source, parts), source, _FLAGS, pack(np.packbits(flags)))
    ties = ~later & ~new
    if ties.any():
        out.add(_home(source, parts), source, _TIES, pack(at[ties].astype(np.uint32), at[head][group[ties]].astype(np.uint32)))
    edges = _buckets(value[head], parts)
    for b in np.flatnonzero(np.diff(edges)):
        h = head[edges[b] : edges[b + 1]]
        h = h[np.argsort(at[h])]  # neighbours in the text: documents and starts then have small steps
        out.add(int(b), source, _HASHES,
                pack(value[h] & np.uint64((1 << 56) - 1), steps(at[h].astype(np.uint32)), steps(owner[h]), steps(start[h])))


def _earliest(parts: int):
    """In a bucket: which windows have an earlier equal one at another source."""

    def run(key, table):
        out = _Out()
        sources, found = [], []
        for source, kind, arrays in _messages(table):
            if kind != _HASHES:
                out.add(_home(source, parts), source, kind, pack(*arrays))
            else:
                sources.append(source)
                found.append((arrays[0], *(np.cumsum(a, dtype=a.dtype) for a in arrays[1:])))
        if found:
            value, at, owner, start = (np.concatenate(c) for c in zip(*found))
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            del found
            order = np.lexsort((start, owner, value))
            v, o, s = value[order], owner[order], start[order]
            new = np.concatenate(([True], v[1:] != v[:-1]))
            head, group = np.flatnonzero(new), np.cumsum(new) - 1
            later = order[(o != o[head][group]) | (s != s[head][group])]
            later.sort()
            edges = np.searchsorted(row[later], np.arange(len(sources) + 1))
            for i, source in enumerate(sources):
                if edges[i] < edges[i + 1]:
                    out.add(_home(source, parts), source, _FOUND, pack(steps(at[later[edges[i] : edges[i + 1]]])))
        return out.table()

    return run


def _cover(length: int, parts: int):
    """At a source: the covered runs of words of each document that loses any."""

    def run(key, table):
        out, source = _Out(), key[0].as_py()
        got = {kind: [] for kind in range(9)}
        for _, kind, arrays in _messages(table):
            got[kind].append(arrays)
        ids, keys, counts = got[_DOCS][0]
        first = np.concatenate(([0], np.cumsum(counts)))
        n = int(first[-1])
        flags = np.unpackbits(got[_FLAGS][0][0], count=n)
        for (at,) in got[_FOUND]:
            flags[np.cumsum(at, dtype=np.int64)] = 1
        for at, like in got[_TIES]:
            flags[at] |= flags[like]
        change = np.zeros(n + 1, dtype=np.int32)
        at = np.flatnonzero(flags)
        change[at] += 1
        change[at + length] -= 1
        covered = np.cumsum(change[:-1]) > 0
        edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # a run of covered words may go on in the next document: cut it there
        inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)]
        inner = np.unique(inner[covered[inner - 1] & covered[inner]]) if n else inner
        begin, end = np.union1d(begin, inner), np.union1d(end, inner)
        doc = np.searchsorted(first, begin, side="right") - 1
        slot = _slot(ids[doc], keys[doc], parts)
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            i = order[edges[p] : edges[p + 1]]
            d = doc[i]
            out.add(int(p), source, _CUTS, pack(ids[d], keys[d], begin[i] - first[d], end[i] - first[d]))
        return out.table()

    return run


def _slot(ids: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the texts of these ids meet their cuts: copies of one text with ids of their own are dealt out."""
    return (mix(keys.view(np.uint64) + mix(ids.view(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _send_texts(parts: int):
    """Texts → compressed packs for each slot."""
    import zstandard

    def run(batches):
        place = TaskContext.get().partitionId()
        for batch in batches:
            slot = _slot(_ids(batch.column("doc_id")), batch.column("key").to_numpy(), parts)
            out = _Out()
            order = np.argsort(slot, kind="stable")
            edges = np.searchsorted(slot[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                rows = batch.take(pa.array(order[edges[p] : edges[p + 1]]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows)
                out.add(int(p), place, _TEXTS, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
            yield from out.table().to_batches()

    return run


def _remove():
    """In a slot: texts and the runs to remove meet."""
    import zstandard

    names = ["doc_id", "n_words", "n_removed", "kept_text", "removed"]
    runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(key, table):
        cuts, packs = {}, []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == _TEXTS:
                packs.append(blob)
                continue
            for i, k, a, b in zip(*(x.tolist() for x in unpack(blob))):
                cuts.setdefault((i, k), set()).add((a, b))
        made = [[], [], [], [], []]
        for blob in packs:
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(blob)).read_all()
            for batch in rows.combine_chunks().to_batches():
                for part in slices(batch):
                    words = cut(part.column("text"))
                    for t, (i, own, k) in enumerate(zip(_ids(part.column("doc_id")).tolist(), part.column("doc_id").to_pylist(), part.column("key").to_pylist())):
                        n, runs = int(words.counts[t]), sorted(cuts.get((i, k), ()))
                        keep = None
                        if runs:
                            keep = np.ones(n, dtype=bool)
                            for a, b in runs:
                                keep[a:b] = False
                        text = words.kept_bytes(t, keep)
                        for column, value in zip(made, (own, n, n - int(keep.sum()) if runs else 0, text, [{"first": a, "last": b - 1} for a, b in runs])):
                            column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), runs_type]
        columns = [pa.array(c, pa.binary()).cast(k) if n == "kept_text" else pa.array(c, k) for n, c, k in zip(names, made, kinds)]
        return pa.table(columns, names=names)

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 20, levels: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, kept_text, removed runs of words.

    ``window`` must be a multiple of 2**levels; the first level's windows have window / 2**levels words.
    """
    if window % (1 << levels) or levels < 1:
        raise ValueError("window must be a multiple of 2**levels, and levels at least 1")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    parts = parts_for(spark, text_bytes(docs), BUCKET_BYTES)
    length = window >> levels
    rows = docs.mapInArrow(_hash_texts(length, parts), _MESSAGE)
    for level in range(levels):
        last = level == levels - 1
        rows = rows.groupBy("to").applyInArrow(_repeated(parts), _MESSAGE)
        rows = rows.groupBy("source").applyInArrow(_double(length << level, last, parts), _MESSAGE)
    rows = rows.groupBy("to").applyInArrow(_earliest(parts), _MESSAGE)
    cuts = rows.groupBy("source").applyInArrow(_cover(window, parts), _MESSAGE)
    texts = docs.mapInArrow(_send_texts(parts), _MESSAGE)
    return cuts.unionByName(texts).groupBy("to").applyInArrow(_remove(), _RESULT)


def _extend(length: int, parts: int):
    """At a source: documents with a repeated window of this length; candidates of twice the length go on."""

    def run(key, table):
        out, source = _Out(), key[0].as_py()
        got = {kind: [] for kind in range(9)}
        for _, kind, arrays in _messages(table):
            got[kind].append(arrays)
        ids, keys, counts, *before = got[_DOCS][0]
        first = np.concatenate(([0], np.cumsum(counts)))
        of = _classes_of(int(first[-1]), got[_CLASSES], got[_REPEATS])
        longest = before[0] if before else np.zeros(len(ids), dtype=np.int64)
        found = np.searchsorted(first, np.flatnonzero(of), side="right") - 1
        longest[np.unique(found)] = length
        out.add(_home(source, parts), source, _DOCS, pack(ids, keys, counts, longest))
        at = np.flatnonzero(inside_text(first, 2 * length))
        at = at[(of[at] > 0) & (of[at + length] > 0)]
        if len(at):
            _send_distinct(out, source, parts, at, mix(mix(of[at]) * np.uint64(3) + of[at + length]))
        return out.table()

    return run


def _longest_of(batches):
    """Documents' messages → rows."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            ids, _, counts, longest = unpack(blob)
            own = pa.array(ids, mask=ids == _LAST)
            yield pa.RecordBatch.from_arrays([own, pa.array(counts.astype(np.int64)), pa.array(longest)], names=["doc_id", "n_words", "longest"])


def repeated_lengths(docs: DataFrame, start: int = 10) -> DataFrame:
    """doc_id, n_words, longest: the longest of the lengths start, 2 * start, 4 * start, … of which a window occurs again.

    Doubling goes on until no candidate survives; each level reads the table that the level before wrote.  0: no
    window of ``start`` words occurs twice.  A window counts as repeated wherever its other occurrence is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    parts = parts_for(spark, text_bytes(docs), BUCKET_BYTES)
    rows, length = docs.mapInArrow(_hash_texts(start, parts), _MESSAGE), start
    while True:
        rows = rows.groupBy("to").applyInArrow(_repeated(parts), _MESSAGE)
        rows = written(rows.groupBy("source").applyInArrow(_extend(length, parts), _MESSAGE), "level")
        if rows.filter(F.col("kind") == _HASHES).isEmpty():
            break
        length *= 2
    return rows.filter(F.col("kind") == _DOCS).select("blob").mapInArrow(_longest_of, "doc_id long, n_words long, longest long")
