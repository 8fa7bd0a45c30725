"""Winnowing against a brute-force search of all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import decontaminate
from sheaf.llm.decontaminate import contamination, is_contaminated, without_contaminated


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                ids = windows.get(tuple(w[a : a + n]))
                if ids:
                    hit |= set(range(a, a + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "f", 1) for d, t in docs], "doc_id long, text string, found string, n_hit int"),
        spark.createDataFrame([(i, t, 2) for i, t in items], f"item_id {'string' if items and isinstance(items[0][0], str) else 'long'}, text string, print int"),
    )


def check(spark, docs, items):
    got = contamination(*tables(spark, docs, items)).select("doc_id", "n_words", "n_hit", "items")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("broadcast", [True, False])
def test_random_texts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "small_side", lambda df: df)
    rng = random.Random(6)
    text = lambda n, v=9: " ".join(rng.choice(["É", "the", "ñu", "x1", "B", "of", "Wé", "z", "q"][:v]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 12, 13, 14, 30]), 9)) for i in range(12)] + [(3, None), (None, text(15)), (20, "!!"), (10, text(13)), (10, text(13))]
    long_items = [t for _, t in items if t and len(words(t)) >= 12]
    docs = [(i, f"{text(rng.randint(0, 30))}, {rng.choice(long_items)}. {text(rng.randint(0, 9))}") for i in range(60)]
    docs += [(None, None), (1, ""), (1, docs[1][1]), (2, "..."), (3, text(20000, 3))]
    check(spark, docs, items)
    check(spark, docs, [i for i in items if len(words(i[1])) >= 13])


def test_fingerprints_are_winnowed(spark):
    """Far fewer fingerprints than windows are kept, and a common passage is one row of items each."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(3000))
    rows = decontaminate._marked(spark.createDataFrame([(text,)], "text string").select(decontaminate.words_of(F.col("text")).alias("words")), [13])
    minima = rows.select(decontaminate._minima(13).alias("m")).first().m
    assert len(minima) == 2988 and len([1 for a, b in zip(minima, minima[1:]) if a != b]) + 1 < 0.25 * len(minima)
    passage = " ".join(f"p{i}" for i in range(16))
    check(spark, [(i, f"a {passage} b") for i in range(5)] + [(9, passage[:-4])], [(f"{i}", passage) for i in range(40)])


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b c")], [(1, "a b")])
    assert contamination(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in contamination(docs, items.limit(0)).select("n_words", "n_hit", "items").collect()] == [(3, 0, [])]


def test_stage_drops_contaminated_rows_only(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, passage), (None, passage), (2, passage + " " + " ".join(f"v{i}" for i in range(600))), (3, "clean"), (3, "clean"), (4, None)]
    kept = without_contaminated(*tables(spark, docs, [(7, passage)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 3, 4] and kept.columns == ["doc_id", "text", "found", "n_hit"]
    found = contamination(*tables(spark, docs, [(7, passage)])).select("doc_id", is_contaminated(F.col("n_hit"), F.col("n_words")).alias("c"))
    assert {r.doc_id for r in found.collect() if r.c} == {1, None}
