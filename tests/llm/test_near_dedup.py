"""Near-duplicate classes against brute force on all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

from sheaf.llm.near_dedup import _band_keys, _distinct_shingles, _registers, near_duplicates
from sheaf.llm.words import cut


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words)))))


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            c = len(a & b)
            if c and 100 * c >= percent * (len(a) + len(b) - c):
                parent[find(i)] = find(j)
    order = lambda d: (d is None, d or 0)
    heads = {}
    for i, (d, _) in enumerate(rows):
        heads[find(i)] = min(heads.get(find(i), d), d, key=order)
    return sorted(((d, len(s), heads[find(i)], d == heads[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "s", 3, "r") for d, t in rows], "doc_id long, text string, source string, n_shingles int, registers string")
    got = sorted((tuple(r) for r in near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)


def test_chain_family(spark):
    """A family of near copies with similarities on both sides of the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(50)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (5, "a b"), (6, "a b c d e"), (7, "a b c d e f"), (None, "lone text"), (None, "a b")]
    rows += [(8, "a b c d e f g h"), (9, "a b c d e f g h i"), (9, "a b c d e f g h i"), (10, "z " * 4000), (11, "z z z z z")]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_pairs_share_a_key():
    """Texts of 8 words and their first or last 7: 3 of 4 shingles in common, exactly 75 %."""
    rng = random.Random(11)
    longer = [[f"w{rng.randrange(10**9)}" for _ in range(8)] for _ in range(6000)]
    shorter = [w[i % 2 : i % 2 + 7] for i, w in enumerate(longer)]
    keys = []
    for side in (longer, shorter):
        owner, value = _distinct_shingles(cut(pa.array([" ".join(w) for w in side])), 5)
        keys.append(_band_keys(_registers(len(side), owner, value)))
    apart = ~(keys[0] == keys[1]).any(axis=1)
    assert np.flatnonzero(apart).tolist() == []
