"""Samples of labelled rows and logistic calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_BYTES = 64 << 10  # longer texts are taken only where shorter ones do not fill the sample
SAMPLE_TOTAL = 64 << 20  # bytes of the texts of one label


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, ids: Column) -> DataFrame:
    """(doc_id, text, y, part): at most ``rows`` labelled documents of each label, by a hash of their id.

    ``ids`` says which labelled ids may be used.  Null labels are ignored; of several labels of one id the largest
    counts, and of several texts one.  Texts over SAMPLE_BYTES come last, and a label's texts end where they reach SAMPLE_TOTAL bytes; both bound the
    sample, not the scores.  ``part`` is 0 for rows that fit the model and 1 for those that calibrate it.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(ids).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    size, key = F.octet_length("text"), F.xxhash64("text")
    place = F.struct((size > SAMPLE_BYTES).alias("long"), key.alias("key"), size.alias("size"))
    there = docs.filter(size > 0).select("doc_id", place.alias("place")).join(known, "doc_id").groupBy("doc_id", "y", "h").agg(F.min("place").alias("place"))
    there = there.select("doc_id", "y", "h", "place.*")
    order = ["long", "h", "doc_id"]
    chosen = [there.filter(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    # at most 2 * rows ids from here on
    before = F.sum("size").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    chosen = chosen[0].union(chosen[1]).withColumn("before", before).filter(F.col("before") < SAMPLE_TOTAL)
    chosen = chosen.select("doc_id", "key", "y", F.pmod("h", F.lit(2)).cast("int").alias("part"))
    texts = docs.filter(size > 0).select("doc_id", key.alias("key"), "text").join(F.broadcast(chosen), ["doc_id", "key"])
    return texts.dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "y", "part")


def label_counts(labels: DataFrame, label: str, ids: Column) -> dict[int, int]:
    """Labelled rows of each label: the shares that a balanced sample hides."""
    known = labels.filter(F.col("doc_id").isNotNull() & ids & F.col(label).isin(0, 1))
    return {int(r.y): r.n for r in known.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: dict[int, int], ridge: float = 0.1, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by damped Newton steps: (mean, deviation, weights with the constant last).

    ``counts``: rows of each label in full; rows weigh so that the labels have these shares.
    """
    each = np.array([counts[k] / max((y == k).sum(), 1) for k in (0, 1)])
    each *= len(y) / (each[0] * (y == 0).sum() + each[1] * (y == 1).sum())
    weight = each[y.astype(int)]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-3

    def loss(v):
        z = a @ v
        return weight @ (np.logaddexp(0, z) - y * z) + v @ penalty @ v / 2

    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * step) > loss(w):
            rate /= 2
        w = w + rate * step
        if np.abs(step).max() * rate < 1e-6:
            break
    return mean, scale, w


def apply_logistic(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return sigmoid(np.c_[(x - mean) / scale, np.ones(len(x))] @ w)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
