"""Top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheaf.llm import topk
from sheaf.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, score int, block string"


def brute(rows, k=5, every=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for q, v in good:
        if q % every or (q, tuple(v)) in asked:
            continue
        asked.add((q, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("id") % 5 == 0, **more).collect())
    assert got == brute(rows, **more)


@pytest.mark.parametrize("blocks", [(512, 1024), (7, 11)])
def test_ties_and_odd_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[1])
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(6)]) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # one common vector
    rows += [(0, rows[0][1]), (5, [1.0] * 6), (300, None), (305, []), (310, [None] * 6), (315, [float("nan")] * 6), (320, [float("inf")] * 6), (None, [0.1] * 6)]
    rows += [(400, [1.0, 2.0]), (401, [3.0, -1.0]), (405, [1e6, -1e6, 3.5])]
    check(spark, rows)
    check(spark, rows, k=1)


def test_few_rows(spark):
    check(spark, [(0, [1.0]), (1, [2.0]), (5, [-3.0])])
    check(spark, [(0, [1.0])])
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0


def test_large_components(spark):
    check(spark, [(0, [3e4, -3e4]), (1, [2.5e4, 1.0]), (2, [-1e3, 4e4]), (5, [1e-9, -1e-9])])
