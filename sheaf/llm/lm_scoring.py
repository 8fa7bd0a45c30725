"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, beside an add-one unigram model.

Tokens are lower-cased words and one end per text.  The probability of a word given the words before it is that of its
class times that of the word within its class.  The HEAD most frequent words have classes of WIDTH words; all others fall
into tail classes by their shape (characters beyond ASCII, final punctuation, length).  There a word's probability mixes its share
among the class's tokens after the word before it, counted over all pairs of the training texts, with its add-one share of the
class's tokens, so unseen words have a probability too; the pairs weigh as much as they recur in the class (the share of its
training tokens whose pair occurs twice or more).  Both softmaxes add, to fixed log frequencies, weights of features of the
context: the word before (n-gram) and the words two and three before (skips), hashed together with the class into ROWS rows.

Counts cover all training texts.  Words travel as 64-bit hashes whose lowest bits hold the shape: each source (some MB of
texts) sends its distinct words once, with counts, and gets the totals back; likewise its distinct pairs before tail words.  The weights are trained on all training texts by
distributed gradient updates: in each of ROUNDS rounds every task takes gradient steps over its share, and the tasks' weights
are averaged row by row, by use.  Weights and head words have a fixed size, word and pair counts follow the corpus; scoring runs in numpy batches.

Rules: a null or empty text is its end alone.  A null id is never held out.  Repeated rows get equal scores.  Without any
training token N and V are 0.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, steps, unpack
from sheaf.llm.common import parts_for, received, send, small_batches, text_bytes
from sheaf.llm.tables import written
from sheaf.llm.words import cut, mix, slices

SOURCE_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
TRAIN_BYTES = 64 << 20
WIDTH, SHAPES = 32, 8
CLASSES = WIDTH - SHAPES
HEAD = CLASSES * WIDTH
ROWS = 1 << 16
ROUNDS, BATCH, RATE, PRIOR = 2, 8192, 0.7, 6.0
BLOCK, SHORT = 1024, 8  # tokens at once; stretches that are summed side by side

_SHAPE = np.uint64(SHAPES - 1)
_END = np.uint64(0xE4D0 << 8)
_START = np.uint64(0x57A7 << 8)
_PAIR, _KEY_BITS = np.uint64(SHAPES), np.uint64(2 * SHAPES - 1)
_PIECES = 16
_ASCII_END = np.zeros(256, dtype=bool)
_ASCII_END[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts, tokens per text); every text ends with the end token."""
    words = cut(texts, lower=True)
    wide = np.concatenate(([0], np.cumsum(words.data >= 0x80)))
    shape = (wide[words.end] > wide[words.start]).astype(np.uint64)
    if len(words.end):
        shape |= _ASCII_END[words.data[words.end - 1]].astype(np.uint64) << np.uint64(1)
    shape |= (words.end - words.start > 7).astype(np.uint64) << np.uint64(2)
    ids = (words.hashes() & ~_SHAPE) | shape
    counts = words.counts + 1
    last = np.cumsum(counts) - 1
    out = np.full(int(counts.sum()), _END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = ids
    return out, counts


def _sources():
    """Texts → (source, docs, words): documents of a source, and its tokens by their distinct words."""
    names = ["source", "docs", "words"]

    def run(batches):
        place, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            ids, none, out, counts, tokens = (np.concatenate(c) for c in zip(*held))
            distinct, inverse = np.unique(tokens, return_inverse=True)
            row = [(place << 32) + number, pack(ids, none, out, counts), pack(steps(distinct), inverse.astype(np.uint32))]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([b], pa.binary()) for b in row[1:])], names=names)

        for batch in batches:
            for part in slices(batch):
                tokens, counts = _tokens(part.column("text"))
                ids = part.column("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                out = part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), none, out, counts.astype(np.uint32), tokens))
                size += 6 * len(tokens)
                if size >= SOURCE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


class _Source:
    """One source unpacked; token-wise arrays on demand."""

    def __init__(self, docs, words):
        self.ids, self.none, self.out, counts = unpack(docs)
        gaps, self.inverse = unpack(words)
        self.distinct = np.cumsum(gaps, dtype=np.uint64)
        self.counts = counts.astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def training(self) -> np.ndarray:
        return np.repeat(self.out == 0, self.counts)

    def places(self) -> np.ndarray:
        """Every token's place in its text."""
        return (np.arange(len(self.inverse)) - np.repeat(self.first[:-1], self.counts)).astype(np.uint32)

    def contexts(self, at: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """For the tokens at ``at`` the words one, two and three before them in their texts."""
        found = []
        for back in (1, 2, 3):
            word = self.distinct.take(self.inverse.take(np.maximum(at - back, 0)))
            word[places.take(at) < back] = _START
            found.append(word)
        return found


def _send_counts(parts: int):
    """Sources → their distinct words and training counts, to the words' buckets."""
    names = ["to", "source", "blob"]

    def run(batches):
        for batch in batches:
            for source, docs, words in zip(*(batch.column(c).to_pylist() for c in ("source", "docs", "words"))):
                s = _Source(docs, words)
                count = np.bincount(s.inverse[s.training()], minlength=len(s.distinct)).astype(np.uint32)
                edges = np.searchsorted((s.distinct >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edges))
                blobs = [pack(steps(s.distinct[edges[b] : edges[b + 1]]), count[edges[b] : edges[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(np.full(len(full), source)), pa.array(blobs, pa.binary())], names=names)

    return run


def _pairs(s: _Source, kind: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the tail tokens, keys): a key for each one's pair of words, then one for the word before and the class.

    The lowest bits of a key hold the class, and whether it stands for a pair.
    """
    at = np.flatnonzero(kind[s.inverse] >= CLASSES)
    before, word = s.contexts(at, places)[0], s.distinct[s.inverse[at]]
    shape = word & _SHAPE
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word)) & ~_KEY_BITS | shape | _PAIR
    return at, np.concatenate([pair, mix(before + mix(shape + np.uint64(1))) & ~_KEY_BITS | shape])


def _send_pairs(shared, parts: int):
    """Sources → their distinct pair keys and training counts, to the keys' buckets."""
    names = ["to", "source", "blob"]

    def run(batches):
        lexicon = received(shared)
        for batch in batches:
            for source, docs, words in zip(*(batch.column(c).to_pylist() for c in ("source", "docs", "words"))):
                s = _Source(docs, words)
                at, keys = _pairs(s, lexicon.classes(s.distinct)[0], s.places())
                distinct, inverse = np.unique(keys, return_inverse=True)
                count = np.bincount(inverse[np.tile(s.training()[at], 2)], minlength=len(distinct)).astype(np.uint32)
                edges = np.searchsorted((distinct >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24), np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edges))
                blobs = [pack(steps(distinct[edges[b] : edges[b + 1]]), count[edges[b] : edges[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(np.full(len(full), source)), pa.array(blobs, pa.binary())], names=names)

    return run


def _total_pairs(first: int):
    """In a bucket: the keys' totals, back to each source; by class the tokens, and those whose pair recurs."""

    def run(key, table):
        names = ["kind", "source", "bucket", "blob", "word", "count", "types"]
        bucket, rows, at = first + key[0].as_py(), [], 0
        sources = table.column("source").to_pylist()
        found = [(np.cumsum(gaps, dtype=np.uint64), count) for gaps, count in map(unpack, table.column("blob").to_pylist())]
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
        for source, (k, _) in zip(sources, found):
            rows.append(("reply", source, bucket, pack(total[inverse[at : at + len(k)]].astype(np.uint64)), None, None, None))
            at += len(k)
        shape = np.where(keys & _PAIR > 0, keys & _SHAPE, np.uint64(SHAPES)).astype(np.int64)
        for k in range(SHAPES):
            own = total[shape == k]
            rows.append(("pair", None, bucket, None, k, int(own.sum()), int(own[own > 1].sum())))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


_TOTALS = "kind string, source long, bucket long, blob binary, word long, count long, types long"


def _total(key, table):
    """In a bucket: the words' totals, back to each source; totals by shape; the most frequent words."""
    names = ["kind", "source", "bucket", "blob", "word", "count", "types"]
    bucket, rows = key[0].as_py(), []
    sources = table.column("source").to_pylist()
    found = [(np.cumsum(gaps, dtype=np.uint64), count) for gaps, count in map(unpack, table.column("blob").to_pylist())]
    words, inverse = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in found]), minlength=len(words)).astype(np.int64)
    at = 0
    for source, (w, _) in zip(sources, found):
        rows.append(("reply", source, bucket, pack(total[inverse[at : at + len(w)]].astype(np.uint64)), None, None, None))
        at += len(w)
    shape = (words & _SHAPE).astype(np.int64)
    for k in range(SHAPES):
        own = total[shape == k]
        rows.append(("shape", None, bucket, None, k, int(own.sum()), int((own > 0).sum())))
    for i in np.lexsort((words, -total))[:HEAD]:
        if total[i] > 0:
            rows.append(("top", None, bucket, None, int(words[i].view(np.int64)), int(total[i]), None))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Lexicon:
    """Classes and fixed log frequencies."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        order = np.argsort(words)
        rank = np.arange(len(words))[order]
        self.words, self.number = words[order], rank
        self.total, self.types = int(tokens.sum()), int(types.sum())
        tail_n, tail_v = tokens.astype(float), types.astype(float)
        shape = (words & _SHAPE).astype(int)
        np.subtract.at(tail_n, shape, counts)
        np.subtract.at(tail_v, shape, 1)
        self.tail_log = np.log(tail_n + tail_v + 1)
        member = np.zeros(HEAD)
        member[: len(words)] = counts
        member = member.reshape(CLASSES, WIDTH)
        self.bias = np.full((CLASSES + 1, WIDTH), -30.0, dtype=np.float32)
        kinds = np.concatenate([member.sum(axis=1), tail_n + tail_v + 1])
        with np.errstate(divide="ignore"):
            self.bias[0] = np.maximum(np.log(kinds) - np.log(kinds.sum()), -30)
            self.bias[1:] = np.maximum(np.log(member) - np.log(np.maximum(member.sum(axis=1, keepdims=True), 1)), -30)

    def classes(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place within it) of each word; tail classes follow the head's and their places are 0."""
        if not len(self.words):
            return CLASSES + (distinct & _SHAPE).astype(np.int64), np.zeros(len(distinct), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        head = self.words[at] == distinct
        number = self.number[at]
        return np.where(head, number // WIDTH, CLASSES + (distinct & _SHAPE).astype(np.int64)), np.where(head, number % WIDTH, 0)


def _rows(contexts: list[np.ndarray], node) -> np.ndarray:
    """Hashed weight rows [tokens, features] of the contexts at a node of the class tree."""
    out = np.empty((len(contexts[0]), len(contexts)), dtype=np.uint16)
    for j, word in enumerate(contexts):
        key = (word + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (np.asarray(node, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, j] = key >> np.uint64(48)
    return out


def _exponents(weights, bias, rows):
    """(exponents of a softmax [tokens, WIDTH], their sums); blocks of tokens that fit the processor's cache."""
    z, total = np.empty((len(rows), WIDTH), dtype=np.float32), np.empty(len(rows), dtype=np.float32)
    rows, bias = rows.astype(np.intp), np.broadcast_to(bias, z.shape)
    for lo in range(0, len(rows), BLOCK):
        own, part = rows[lo : lo + BLOCK], z[lo : lo + BLOCK]
        np.take(weights, own[:, 0], axis=0, out=part, mode="clip")
        for j in range(1, own.shape[1]):
            part += weights.take(own[:, j], axis=0, mode="clip")
        part += bias[lo : lo + BLOCK]
        most = part
        while most.shape[1] > 1:
            half = most.shape[1] // 2
            most = np.maximum(most[:, :half], most[:, half:])
        part -= most
        np.exp(part, out=part)
        np.add.reduce(part, axis=1, out=total[lo : lo + BLOCK])
    return z, total


def _softmax(weights, bias, rows):
    z, total = _exponents(weights, bias, rows)
    z /= total[:, None]
    return z


def _chosen(weights, bias, rows, target):
    """The softmax's value at each token's target."""
    z, total = _exponents(weights, bias, rows)
    return z[np.arange(len(target)), target] / total


def _sums(g, at, head, n):
    """Sums of the rows ``g[at]`` over the stretches that begin at ``head`` and have ``n`` rows."""
    out = np.empty((len(head), g.shape[1]), dtype=g.dtype)
    short = n <= SHORT
    for length in range(1, SHORT + 1):
        own = np.flatnonzero(n == length)
        if not len(own):
            continue
        first = head[own]
        if length > 1:
            total = g.take(at[first + 1], axis=0)
            for i in range(2, length):
                total += g.take(at[first + i], axis=0)
            total += g.take(at[first], axis=0)
        else:
            total = g.take(at[first], axis=0)
        out[own] = total
    if not short.all():
        own = np.flatnonzero(~short)
        begin = np.concatenate(([0], np.cumsum(n[own])[:-1]))
        kept = at[np.repeat(~short, n)]
        out[own] = np.add.reduceat(g.take(kept, axis=0), begin, axis=0)
    return out


def _update(weights, uses, bias, rows, target) -> None:
    """One gradient step on a batch; a row moves by its mean gradient, less where it is rare."""
    g = _softmax(weights, bias, rows)
    g[np.arange(len(target)), target] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat.take(order).astype(np.intp)
    head = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    own = sorted_rows[head]
    n = np.diff(np.append(head, len(flat)))
    total = _sums(g, np.repeat(np.arange(len(rows)), rows.shape[1]).take(order), head, n)
    n = n.astype(np.float32)
    total *= np.float32(RATE / rows.shape[1] ** 0.5)
    total /= (n + np.float32(PRIOR))[:, None]
    np.subtract(weights.take(own, axis=0), total, out=total)
    weights[own] = total
    uses[own] += n


def _train(shared, turn: int):
    """Sources → weights after gradient steps over their training tokens of this round, in pieces."""
    names = ["piece", "blob"]

    def run(batches):
        lexicon, weights = received(shared)
        weights = weights.copy()
        uses = np.zeros(ROWS, dtype=np.float32)
        for batch in batches:
            for source, docs, words in zip(*(batch.column(c).to_pylist() for c in ("source", "docs", "words"))):
                s = _Source(docs, words)
                kind, place = lexicon.classes(s.distinct)
                mine = np.repeat((s.out == 0) & (np.arange(len(s.out)) % ROUNDS == turn), s.counts)
                at = np.random.default_rng(abs(source) % 2**32).permutation(np.flatnonzero(mine))
                places = s.places()
                for lo in range(0, len(at), BATCH):
                    i = at[lo : lo + BATCH]
                    context, word = s.contexts(i, places), s.inverse[i]
                    own = kind[word]
                    _update(weights, uses, lexicon.bias[0], _rows(context, 0), own)
                    head = np.flatnonzero(own < CLASSES)
                    if len(head):
                        node = own[head] + 1
                        _update(weights, uses, lexicon.bias[node], _rows([c[head] for c in context], node), place[word[head]])
        size = ROWS // _PIECES
        for p in range(_PIECES):
            used = np.flatnonzero(uses[p * size : (p + 1) * size]) + p * size
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([pack(used.astype(np.uint32), uses[used], weights[used].ravel())], pa.binary())], names=names)

    return run


def _average(key, table):
    """A piece of the weights: each row's mean over the tasks, by use."""
    size = ROWS // _PIECES
    base = key[0].as_py() * size
    total, uses = np.zeros((size, WIDTH)), np.zeros(size)
    for blob in table.column("blob").to_pylist():
        at, n, w = unpack(blob)
        at = at.astype(np.int64) - base
        total[at] += w.reshape(-1, WIDTH) * n[:, None]
        uses[at] += n
    used = np.flatnonzero(uses)
    mean = (total[used] / uses[used][:, None]).astype(np.float32)
    return pa.table({"piece": pa.array([key[0].as_py()]), "blob": pa.array([pack((used + base).astype(np.uint32), mean.ravel())], pa.binary())})


def _after(count: np.ndarray, total: np.ndarray, share: np.ndarray, recur: np.ndarray) -> np.ndarray:
    """Tail words' probabilities in their class: pair counts by those of the word before, mixed with the share."""
    return np.where(total > 0, recur * count / np.maximum(total, 1) + (1 - recur) * share, share)


def _score(shared, parts: int):
    """A source and the totals of its words and pairs → one row per document."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(key, table):
        lexicon, weights, recur = received(shared)
        docs, words, replies = None, None, []
        for bucket, blob, d, w in zip(*(table.column(c).to_pylist() for c in ("bucket", "blob", "docs", "words"))):
            if d is not None:
                docs, words = d, w
            else:
                replies.append((bucket, blob))
        s = _Source(docs, words)
        replies.sort()
        count = np.concatenate([unpack(b)[0] for n, b in replies if n < parts]).astype(np.float64)
        kind, place = lexicon.classes(s.distinct)
        base = np.log10((count + 1) / (lexicon.total + lexicon.types + 1))
        tail = np.where(kind >= CLASSES, np.log(count + 1) - lexicon.tail_log[np.maximum(kind - CLASSES, 0)], 0.0)
        places = s.places()
        score = tail[s.inverse]
        at, keys = _pairs(s, kind, places)
        if len(at):
            met = np.concatenate([unpack(b)[0] for n, b in replies if n >= parts])[np.unique(keys, return_inverse=True)[1]].astype(np.float64)
            score[at] = np.log(_after(met[: len(at)], met[len(at) :], np.exp(score[at]), recur[kind[s.inverse[at]] - CLASSES]))
        for lo in range(0, len(score), BATCH):
            hi = min(lo + BATCH, len(score))
            context, word = s.contexts(np.arange(lo, hi), places), s.inverse[lo:hi]
            own = kind[word]
            score[lo:hi] += np.log(_chosen(weights, lexicon.bias[0], _rows(context, 0), own))
            head = np.flatnonzero(own < CLASSES)
            if len(head):
                node = own[head] + 1
                p = _chosen(weights, lexicon.bias[node], _rows([c[head] for c in context], node), place[word[head]])
                score[lo + head] += np.log(p)
        by_doc = lambda x: np.add.reduceat(x, s.first[:-1])  # noqa: E731  every text has its end
        columns = [
            pa.array(s.ids, mask=s.none > 0), pa.array(s.out > 0), pa.array(s.counts), pa.array(by_doc((count > 0)[s.inverse].astype(np.int64))),
            pa.array(by_doc(base[s.inverse])), pa.array(by_doc(score) / np.log(10)),
        ]
        return pa.table(columns, names=names)

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: condition on doc_id of the texts that nothing is learnt from.  Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(docs)
    parts = parts_for(spark, size, BUCKET_BYTES)
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    sources = written(docs.mapInArrow(_sources(), "source long, docs binary, words binary"), "sources")
    counts = sources.mapInArrow(_send_counts(parts), "to long, source long, blob binary")
    totals = written(counts.groupBy("to").applyInArrow(_total, _TOTALS), "totals")
    shapes = totals.filter("kind = 'shape'").groupBy("word").agg(F.sum("count").alias("n"), F.sum("types").alias("v")).collect()
    tokens, types = np.zeros(SHAPES, dtype=np.int64), np.zeros(SHAPES, dtype=np.int64)
    for r in shapes:
        tokens[r.word], types[r.word] = r.n, r.v
    top = totals.filter("kind = 'top'").orderBy(F.desc("count"), "word").limit(HEAD).select("word", "count").collect()
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    lexicon = Lexicon(words, np.array([r["count"] for r in top], dtype=np.int64), tokens, types)
    weights = np.zeros((ROWS, WIDTH), dtype=np.float32)
    workers = max(1, -(-size // TRAIN_BYTES))
    for turn in range(ROUNDS):
        shared = send(spark, (lexicon, weights))  # a fixed size
        pieces = sources.coalesce(workers).mapInArrow(_train(shared, turn), "piece long, blob binary")
        weights = weights.copy()
        for r in pieces.groupBy("piece").applyInArrow(_average, "piece long, blob binary").collect():
            at, w = unpack(r.blob)
            weights[at] = w.reshape(-1, WIDTH)
        shared.unpersist()
    known = send(spark, lexicon)
    pairs = sources.mapInArrow(_send_pairs(known, parts), "to long, source long, blob binary")
    pairs = written(pairs.groupBy("to").applyInArrow(_total_pairs(parts), _TOTALS), "totals")
    known.unpersist()
    recur = np.zeros(SHAPES)
    for r in pairs.filter("kind = 'pair'").groupBy("word").agg(F.sum("count").alias("n"), F.sum("types").alias("again")).collect():
        recur[r.word] = r.again / (r.n + 1)
    shared = send(spark, (lexicon, weights, recur))
    empty = F.lit(None).cast("binary")
    own = sources.select("source", F.lit(None).cast("long").alias("bucket"), empty.alias("blob"), "docs", "words")
    replies = totals.unionByName(pairs).filter("kind = 'reply'").select("source", "bucket", "blob", empty.alias("docs"), empty.alias("words"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = own.unionByName(replies).groupBy("source").applyInArrow(_score(shared, parts), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")
