"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import substring_dedup
from sheaf.llm.substring_dedup import remove_repeated_windows, repeated_lengths


def brute(rows, window=20):
    first, cut = {}, []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        cut.append(words)
        for i in range(len(words) - window + 1):
            own = ((d is None, d or 0), i)
            seq = tuple(words[i : i + window])
            first[seq] = min(first.get(seq, own), own)
    out = []
    for (d, _), words in zip(rows, cut):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if ((d is None, d or 0), i) > first[tuple(words[i : i + window])]:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window=20, levels=1):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, key string").repartition(3)
    got = remove_repeated_windows(docs, window, levels).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, window)


ODD = [
    (1, "a " * 50), (1, "a " * 50), (None, "a " * 30), (None, None), (3, ""), (4, "x"), (5, "\t\n \r"), (6, "é b " * 25),
    (2, " ".join(map(str, range(100)))), (2, " ".join(map(str, range(50, 150)))), (7, " ".join(map(str, range(60, 90)))),
    (2, " ".join(map(str, range(100)))), (8, "w" * 100_000), (9, " ".join(map(str, range(30000)))), (10, " ".join(map(str, range(29000, 29025)))),
]


@pytest.mark.parametrize("levels", [1, 2])
def test_odd_rows(spark, levels):
    check(spark, ODD, levels=levels)


def test_random_passages_over_many_sources(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SOURCE_BYTES", 500)
    rng = random.Random(2)
    passages = [[f"p{i}_{j}" for j in range(rng.randint(4, 40))] for i in range(12)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9))]
        rows.append((rng.randrange(100), " ".join(words)))
    check(spark, rows, window=8, levels=1)
    check(spark, rows, window=8, levels=3)


def test_empty_table_and_bad_window(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(docs).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_windows(docs, window=7)


def test_lengths_double_until_none_survives(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SOURCE_BYTES", 400)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(f"a{rng.randrange(10**7)}" for _ in range(9)) + " " + " ".join(shared[: 3 * i + 2])) for i in range(60)] + [(None, None), (99, "x " * 200), (7, "")]
    count = {}
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for length in (5, 10, 20, 40, 80, 160, 320):
        for w in cut:
            for i in range(len(w) - length + 1):
                seq = tuple(w[i : i + length])
                count[seq] = count.get(seq, 0) + 1
    want = []
    for (d, _), w in zip(rows, cut):
        longest = max([n for n in (5, 10, 20, 40, 80, 160, 320) for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1], default=0)
        want.append((d, len(w), longest))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in repeated_lengths(docs, start=5).collect()), key=str) == sorted(want, key=str)
    assert repeated_lengths(docs.limit(0)).count() == 0
