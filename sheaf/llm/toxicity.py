"""Toxicity by class-conditional Kneser-Ney models of words.

Two bigram models, of toxic and of ordinary labelled texts.  Each backs off to the class's continuation counts (in how many
contexts a word occurs) and these to continuation counts shared by both classes, so a rare expression is smoothed alike in
both.  A text's log-likelihoods are compared per word, over the whole text and in its most toxic
stretch of STRETCH words; a logistic regression on other labelled texts makes a score of them.

At most ROWS labelled rows of each label are used, half for the counts (made by Spark) and half for the calibration.
Bigrams seen less than LEAST times in the sample are left to their backoff.  Words are lower-cased (A to Z) and stripped of ASCII punctuation.

Rules: a null or empty text scores as a text of likelihood ratio 1.  If rows or words of one label are missing, every score is the
share of label 1 among the labelled rows, 0 without any.  Repeated rows get equal scores.  Result columns replace
columns of the same name; others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import received, send, small_batches
from sheaf.llm.learning import apply_logistic, fit_logistic, label_counts, labelled_sample
from sheaf.llm.words import Words, cut, mix, slices

ROWS = 6000
DISCOUNT = 0.75
LEAST = 2
STRETCH = 6
STRONG = (0.1, 0.35, 1.0)

_START = np.uint64(0x51A7)


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(previous word or start, word) hashes of all words."""
    word = words.hashes()
    before = np.empty_like(word)
    before[1:] = word[:-1]
    first = words.first[:-1][words.counts > 0]
    before[first] = _START
    return before, word


def _plain(texts: pa.Array) -> Words:
    """Lower-cased words without the punctuation at their ends."""
    words = cut(texts, lower=True)
    mark = _PUNCTUATION[words.data]
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        more = (end - start > 1) & mark[np.maximum(end - 1, 0)]
        end -= more
        more = (end - start > 1) & mark[np.minimum(start, max(len(mark) - 1, 0))]
        start += more
    return Words(words.data, words.text_at, start, end, words.first)


_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _count(batches):
    """Sample rows → (y, before, word, n)."""
    for batch in batches:
        for part in slices(batch):
            words = _plain(part.column("text"))
            before, word = _pairs(words)
            kind = np.repeat(part.column("y").to_numpy(), words.counts)
            order = np.lexsort((word, before, kind))
            k, b, w = kind[order], before[order], word[order]
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]) | (w[1:] != w[:-1])))) if len(k) else np.zeros(0, int)
            n = np.diff(np.append(new, len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(k[new].astype(np.int32)), pa.array(b[new].view(np.int64)), pa.array(w[new].view(np.int64)), pa.array(n.astype(np.int64))], names=["y", "before", "word", "n"])


class KneserNey:
    """Log-likelihood ratios of words after words, toxic over ordinary."""

    def __init__(self, y, before, word, n, least: int = LEAST):
        before, word = before.view(np.uint64), word.view(np.uint64)
        self.vocabulary = np.unique(word)
        size = len(self.vocabulary)
        at = np.searchsorted(self.vocabulary, word)
        shared = np.bincount(at, minlength=size).astype(float)  # contexts in either class
        total = shared.sum()
        base = np.maximum(shared - DISCOUNT, 0) / total + DISCOUNT * size / total / (size + 1)
        unseen = DISCOUNT * size / total / (size + 1)
        names = mix(before * np.uint64(31)) ^ word
        seen, common = np.unique(names[n >= least], return_index=True)
        pick = np.flatnonzero(n >= least)[common]
        self.pairs = seen
        likelihood, ends, reach = [], [], []
        for label in (0, 1):
            own = y == label
            contexts = np.bincount(at[own], minlength=size).astype(float)
            types = contexts.sum()
            kept = (contexts > 0).sum()
            spare = DISCOUNT * kept / types
            word_p = np.maximum(contexts - DISCOUNT, 0) / types + spare * base
            likelihood.append(np.log(word_p))
            ends.append(np.log(spare * unseen))
            reach.append(np.log(types if label else spare / total))
            context, where = np.unique(before[own], return_inverse=True)
            tokens = np.bincount(where, weights=n[own])
            follow = np.bincount(where).astype(float)
            # the bigrams kept: discounted count over the context's count, plus the context's share of the backoff
            order = np.argsort(names[own])
            at_pair = np.minimum(np.searchsorted(names[own][order], seen), max(own.sum() - 1, 0))
            hit = names[own][order][at_pair] == seen
            count = np.where(hit, n[own][order][at_pair], 0).astype(float)
            i = np.minimum(np.searchsorted(context, before[pick]), len(context) - 1)
            known = context[i] == before[pick]
            c, f = np.where(known, tokens[i], 1.0), np.where(known, follow[i], 0.0)
            back = np.where(known, DISCOUNT * f / c, 1.0)
            p = np.maximum(count - DISCOUNT, 0) / c + back * word_p[np.searchsorted(self.vocabulary, word[pick])]
            likelihood.append(np.log(p))
        self.word_ratio = np.append(likelihood[2] - likelihood[0], ends[1] - ends[0]).astype(np.float32)
        # what the ratio of a word tends to that is toxic in ever more contexts and ordinary in none
        self.cap = -reach[0] - reach[1]
        self.pair_ratio = (likelihood[3] - likelihood[1]).astype(np.float32)

    def ratios(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One log-likelihood ratio for each word."""
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        at[self.vocabulary[at] != word] = len(self.vocabulary)
        out = self.word_ratio[at].astype(np.float64)
        if len(self.pairs):
            # only words that some kept bigram could hold are looked up
            known = np.flatnonzero(at < len(self.vocabulary))
            name = mix(before[known] * np.uint64(31)) ^ word[known]
            i = np.minimum(np.searchsorted(self.pairs, name), len(self.pairs) - 1)
            hit = self.pairs[i] == name
            out[known[hit]] = self.pair_ratio[i[hit]]
        return out


def _features(model: KneserNey, texts: pa.Array) -> np.ndarray:
    """Per text: the ratio per word over all of it and in its most toxic stretch, words near the highest ratio, the length."""
    words = _plain(texts)
    ratio = model.ratios(*_pairs(words)) if len(words.start) else np.zeros(0)
    sums = np.concatenate(([0.0], np.cumsum(ratio)))
    first, count = words.first, words.counts
    total = sums[first[1:]] - sums[first[:-1]]
    stretch = np.zeros(len(count))
    some = np.flatnonzero(count > 0)
    if len(some):
        end = np.minimum(np.arange(len(ratio)) + STRETCH, np.repeat(first[1:], count))
        best = np.maximum.reduceat(sums[end] - sums[:-1], first[:-1][some])
        stretch[some] = best / STRETCH
    strong = [np.log1p(np.bincount(words.text_of(), weights=ratio > model.cap - near, minlength=len(count))) for near in STRONG]
    return np.stack([total / np.maximum(count, 1), stretch, *strong, np.log1p(count)], axis=1)


def train(docs: DataFrame, labels: DataFrame, ids: Column, rows: int = ROWS, least: int = LEAST) -> dict:
    """The models and the calibration, from a bounded sample; bigrams that occur less than ``least`` times in it are left to their backoff."""
    small_batches(docs.sparkSession)
    from sheaf.llm.tables import written

    sample = written(labelled_sample(docs, labels, "toxic", rows, ids), "sample")
    kinds = {(r.y, r.part): r.n for r in sample.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 4:
        return {"constant": _share(kinds)}
    counts = sample.filter("part = 0").select("text", "y").mapInArrow(_count, "y int, before long, word long, n long")
    counts = counts.groupBy("y", "before", "word").agg(F.sum("n").alias("n")).orderBy("y", "before", "word").toArrow()
    if len(counts.column("y").unique()) < 2:  # no words of one label
        return {"constant": _share(kinds)}
    model = KneserNey(*(counts.column(c).to_numpy() for c in ("y", "before", "word", "n")), least=least)
    shared = send(docs.sparkSession, model)
    fitted = sample.filter("part = 1").mapInArrow(_feature_rows(shared), "doc_id long, y int, x array<double>").orderBy("doc_id").collect()
    return {"model": model, "logistic": fit_logistic(np.array([r.x for r in fitted]), np.array([r.y for r in fitted], dtype=float), label_counts(labels, "toxic", ids))}


def _share(kinds: dict[tuple[int, int], int]) -> float:
    """The share of label 1 in the sample."""
    total = sum(kinds.values())
    return sum(n for (y, _), n in kinds.items() if y == 1) / total if total else 0.0


def _feature_rows(shared):
    def run(batches):
        model = received(shared)
        for batch in batches:
            for part in slices(batch):
                x = _features(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return run


def _score(shared, names: list[str]):
    def run(batches):
        model = received(shared)
        for batch in batches:
            for part in slices(batch):
                if "model" in model:
                    scores = apply_logistic(model["logistic"], _features(model["model"], part.column("text")))
                else:
                    scores = np.full(part.num_rows, model["constant"])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores)], names=[*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows with score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    shared = send(spark, model)  # bounded by the sample
    out = docs.mapInArrow(_score(shared, docs.columns), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
