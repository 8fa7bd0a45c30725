"""Quality and toxicity: held-out accuracy on the given labels, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import learning, quality, toxicity
from sheaf.llm.learning import fit_logistic
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
CASES = [("op7_quality", "quality", 3, 1, 0.5), ("op3_toxicity", "toxic", 4, 2, 0.3)]


@pytest.mark.parametrize("name,label,n,out,threshold", CASES)
def test_held_out_accuracy(spark, name, label, n, out, threshold):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) and r.predicted == (r.score >= threshold) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    for k in (0, 1):
        own = [r for r in held if r[label] == k]
        assert np.mean([r.predicted == k for r in own]) > 0.9


def words(i, bad):
    base = " ".join(f"word{(i * 7 + j) % 50}" for j in range(40))
    return (base.upper() + "!!! " * 30 + " awful idiot") if bad else base


@pytest.mark.parametrize("module,label,score", [(quality, "quality", quality.score_quality), (toxicity, "toxic", toxicity.score_toxicity)])
def test_odd_rows(spark, module, label, score):
    rows = [(i, words(i, i % 3 == 0), "s", 5.0) for i in range(90)] + [(200, None, "s", 1.0), (None, "", "s", 1.0), (202, "x" * 100_000, "s", 2.0), (1, words(1, False), "t", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = [(i, int((i % 3 == 0) == (label == "toxic"))) for i in range(80)] + [(None, 1), (3, None), (200, 1), (5, 1 if label == "quality" else 0)]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int")
    every = F.lit(True)
    got = score(docs, module.train(docs, labels, every)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "score", "predicted"}
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id < 90}
    bad, good = [by[i] for i in by if i % 3 == 0], [by[i] for i in by if i % 3]
    assert (min(bad) > max(good)) if label == "toxic" else (max(bad) < min(good))
    one = labels.filter(f"{label} = 1")
    assert {r.score for r in score(docs, module.train(docs, one, every)).collect()} == {1.0}
    assert score(docs.limit(0), module.train(docs.limit(0), labels, every)).count() == 0
    none = labels.limit(0)
    assert {r.score for r in score(docs, module.train(docs, none, every)).collect()} == {0.5 if label == "quality" else 0.0}


def test_logistic_follows_the_shares():
    x, y = np.zeros((10, 1)), np.array([0.0] * 5 + [1.0] * 5)
    _, _, w = fit_logistic(x, y, {0: 90, 1: 10})
    assert abs(1 / (1 + np.exp(-w[-1])) - 0.1) < 0.02


def test_labelled_texts_without_words_or_all_long(spark):
    every = F.lit(True)
    blank = spark.createDataFrame([(i, " " if i % 3 == 0 else words(i, False)) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 > 0)) for i in range(60)], "doc_id long, toxic int, quality int")
    model = toxicity.train(blank, marks, every)
    assert abs(model["constant"] - 1 / 3) < 1e-9
    assert {r.score for r in toxicity.score_toxicity(blank, model).collect()} == {model["constant"]}
    long = blank.withColumn("text", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("awful idiot ")).otherwise(F.lit("kind words ")), F.repeat(F.lit("and so on "), 8000)))
    for module, score in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        made = module.train(long, marks, every)
        assert "constant" not in made
        assert len({r.score for r in score(long, made).collect()}) > 1


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(learning, "SAMPLE_BYTES", 30)
    monkeypatch.setattr(learning, "SAMPLE_TOTAL", 100)
    docs = spark.createDataFrame([(i, "x" * (20 if i < 10 else 50)) for i in range(20)] + [(3, "y" * 40), (4, None), (5, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = learning.labelled_sample(docs, marks, "quality", 50, F.lit(True)).collect()
    assert sorted(r.doc_id for r in got) == list(range(10)) and all(r.text == "x" * 20 for r in got)
    few = learning.labelled_sample(docs.filter("doc_id > 7"), marks, "quality", 50, F.lit(True)).collect()
    assert {8, 9} < {r.doc_id for r in few} and all(sum(len(r.text) for r in few if r.y == y) < 150 for y in (0, 1))


def kneser_ney(rows, d=toxicity.DISCOUNT):
    """(word ratio, pair ratio, unknown ratio) by the definitions, from (y, before, word, n)."""
    from math import log

    shared, contexts, tokens, follow, n_of = {}, ({}, {}), ({}, {}), ({}, {}), {}
    for y, b, w, n in rows:
        shared[w] = shared.get(w, 0) + 1
        contexts[y][w] = contexts[y].get(w, 0) + 1
        tokens[y][b] = tokens[y].get(b, 0) + n
        follow[y][b] = follow[y].get(b, 0) + 1
        n_of[y, b, w] = n
    total, size = sum(shared.values()), len(shared)
    unseen = d * size / total / (size + 1)

    def word_p(y, w):
        types = sum(contexts[y].values())
        base = (max(shared[w] - d, 0) / total if w in shared else 0) + unseen
        return max(contexts[y].get(w, 0) - d, 0) / types + d * len(contexts[y]) / types * base

    def pair_p(y, b, w):
        if b not in tokens[y]:
            return word_p(y, w)
        return max(n_of.get((y, b, w), 0) - d, 0) / tokens[y][b] + d * follow[y][b] / tokens[y][b] * word_p(y, w)

    return lambda w: log(word_p(1, w) / word_p(0, w)), lambda b, w: log(pair_p(1, b, w) / pair_p(0, b, w))


@pytest.mark.parametrize("least", [1, 2])
def test_kneser_ney_by_its_definition(least):
    rng = np.random.default_rng(3)
    found = {}
    for y, b, w in zip(rng.integers(0, 2, 400), rng.integers(1, 9, 400), rng.integers(1, 12, 400)):
        key = (int(y), int(b), int(w) + (20 if y and w > 9 else 0))
        found[key] = found.get(key, 0) + 1
    rows = [(*k, n) for k, n in sorted(found.items())]
    y, before, word, n = (np.array(c, np.int64) for c in zip(*rows))
    model = toxicity.KneserNey(y, before, word, n, least=least)
    word_ratio, pair_ratio = kneser_ney(rows)
    often = {(b, w) for _, b, w, k in rows if k >= least}
    asked = [(b, w) for b in range(0, 12) for w in [*range(1, 12), 30, 31, 99]]
    got = model.ratios(np.array([b for b, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint64))
    want = [pair_ratio(b, w) if (b, w) in often else word_ratio(w) for b, w in asked]
    assert np.allclose(got, want, atol=1e-5)


def test_quality_scores_by_their_definition(spark):
    import math

    import zstandard

    docs = spark.createDataFrame([(i, words(i, i % 3 == 0)) for i in range(90)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    model = quality.train(docs, marks, F.lit(True))
    mean, scale, w = model["logistic"]
    makers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in model["dictionaries"]]
    makers.append(zstandard.ZstdCompressor(level=quality.LEVEL))
    for r in quality.score_quality(docs.filter("doc_id > 70"), model).collect():
        bad, good, plain, size = (math.log(k + 8) for k in [*(len(m.compress(r.text.encode())) for m in makers), len(r.text.encode())])
        x = [bad - good, plain - good, plain - bad, size - plain, (size - plain) ** 2, size]
        z = sum(a * (b - m) / s for a, b, m, s in zip(w, x, mean, scale)) + w[-1]
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


WITHOUT_THE_PACKAGE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from sheaf.session import build_session
spark = build_session("t", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1"}})
def absent(rows):
    import importlib.util
    yield importlib.util.find_spec("sheaf") is None
assert spark.sparkContext.parallelize([1], 1).mapPartitions(absent).collect() == [True]
from sheaf.llm import toxicity, lm_scoring
docs = spark.createDataFrame([(i, ("awful " if i % 2 else "nice ") * 5 + "word%d" % (i % 7)) for i in range(40)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
assert toxicity.score_toxicity(docs, toxicity.train(docs, labels, F.lit(True))).filter("score > 0.5").count() == 20
assert lm_scoring.score_texts(docs, F.col("doc_id") % 7 == 2).count() == 40
print("fine")
"""


def test_executors_need_not_have_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WITHOUT_THE_PACKAGE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]
