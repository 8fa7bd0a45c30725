"""LM scores: counts against brute force, probabilities that add up, and a better fit than the unigrams."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.llm import lm_scoring
from sheaf.llm.lm_scoring import CLASSES, HEAD, WIDTH, Lexicon, _rows, _softmax, _tokens, score_texts
from sheaf.llm.learning import remainder
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def cut(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def check(rows, out):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t)), 5)) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    assert got == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)


def test_query_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op8_lm_scoring"](spark, SF).collect()
    check(rows, out)
    held = [r for r in out if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.05


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SOURCE_BYTES", 200)
    rows = [(i, f"Word{i % 3} of the é{i % 5}, text {i}!") for i in range(60)] + [(None, None), (1, ""), (2, "the " * 5000), (2, "the " * 5000), (99, "unseen")]
    docs = spark.createDataFrame([(i, t, "k", 0.0) for i, t in rows], "doc_id long, text string, kind string, score double").repartition(4)
    out = score_texts(docs, remainder(F.col("doc_id"), 7) == 2).collect()
    check(rows, out)
    assert score_texts(docs.limit(0), F.lit(False)).count() == 0
    alone = score_texts(docs.filter("doc_id = 99"), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in alone] == [(0, 0, 0.0)]


def test_probabilities_add_up():
    tokens, _ = _tokens(pa.array([" ".join(f"w{i % 900}é"[: 2 + i % 4] for i in range(5000)), "a b c, d. abcdefghij"]))
    words, counts = np.unique(tokens, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    shape = (words & np.uint64(7)).astype(int)
    n, v = np.bincount(shape, weights=counts, minlength=8).astype(int), np.bincount(shape, minlength=8)
    lexicon = Lexicon(words[order[:HEAD]], counts[order[:HEAD]], n, v)
    weights = np.random.default_rng(0).normal(size=(1 << 16, WIDTH)).astype(np.float32)
    context = [np.array([7], dtype=np.uint64)] * 3
    kind, place = lexicon.classes(words)
    total = 0.0
    root = _softmax(weights, lexicon.bias[0], _rows(context, 0))[0]
    for w, c, k, p in zip(words, counts, kind, place):
        inside = _softmax(weights, lexicon.bias[k + 1][None], _rows(context, np.array([k + 1])))[0][p] if k < CLASSES else (c + 1) / math.exp(lexicon.tail_log[k - CLASSES])
        total += root[k] * inside
    unseen = sum(root[CLASSES + s] / math.exp(lexicon.tail_log[s]) for s in range(8))
    assert abs(total + unseen - 1) < 1e-3


def test_rare_words_follow_their_context(spark):
    """Words beyond the head: the same held-out words score better after the word they follow in the training texts."""
    rare = [f"w{i:05}" for i in range(2 * HEAD)]
    rows = [(1000 * n + k, " ".join(rare[k : k + 8])) for n in range(3) for k in range(0, 2 * HEAD, 8)]
    same = " ".join(rare)
    mixed = " ".join(rare[::2] + rare[1::2])
    docs = spark.createDataFrame(rows + [(90001, same), (90002, mixed)], "doc_id long, text string")
    out = {r.doc_id: r for r in score_texts(docs, F.col("doc_id") > 90000).filter("held_out").collect()}
    assert out[90001].n_known == out[90002].n_known == 2 * HEAD + 1
    assert out[90001].score > out[90002].score + 0.5 * HEAD


def test_pair_probabilities_add_up():
    share, count = np.array([0.5, 0.3, 0.1]), np.array([4.0, 0.0, 2.0])  # 0.1 is left for unseen words
    assert abs(lm_scoring._after(count, np.full(3, 6.0), share, np.full(3, 0.4)).sum() + 0.6 * 0.1 - 1) < 1e-12
    assert (lm_scoring._after(np.zeros(3), np.zeros(3), share, np.full(3, 0.4)) == share).all()


def test_sums_of_stretches_and_chosen_values():
    """Short stretches are summed side by side and only the asked value of a softmax is divided, with the same bits as before."""
    rng = np.random.default_rng(3)
    flat = np.sort(rng.zipf(1.3, 5000) % 700)
    head = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    n, at = np.diff(np.append(head, len(flat))), rng.permutation(5000) // 3
    g = rng.normal(size=(1700, WIDTH)).astype(np.float32)
    lm = lm_scoring
    assert n.min() <= lm.SHORT < n.max()
    assert (lm._sums(g, at, head, n) == np.add.reduceat(g[at], head, axis=0)).all()
    weights, rows = rng.normal(size=(lm.ROWS, lm.WIDTH)).astype(np.float32), rng.integers(0, lm.ROWS, (3000, 3)).astype(np.uint16)
    target = rng.integers(0, lm.WIDTH, 3000)
    for bias in (weights[7], weights[:3000]):
        z = weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]] + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        assert (lm._softmax(weights, bias, rows) == z).all()
        assert (lm._chosen(weights, bias, rows, target) == z[np.arange(3000), target]).all()
