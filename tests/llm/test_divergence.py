"""The divergence audit against brute force in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheaf.llm import divergence
from sheaf.llm.divergence import audit, shares, terms_of


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for lang, source, text in rows]
    df, count, groups = Counter(), defaultdict(Counter), set()
    for lang, source, words in docs:
        groups.add((lang, source))
        count[lang, source].update(words)
        count[lang,].update(words)
        df.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]
        v = len(kept)

        def p(key):
            total = sum(count[key][w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[key][w] + 5) // (total + 5 * v) for w in kept}

        whole, mine = p((lang,)), {g: p(g) for g in groups if g[0] == lang}
        for g, own in mine.items():
            pair = [(-sum(abs(own[w] - q[w]) for w in kept), h[1]) for h, q in mine.items() if h != g]
            term = [(whole[w] - own[w], w) for w in kept if count[g][w] > 0 and own[w] > whole[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                for i, (value, item) in enumerate(found[: top if part == "term" else None]):
                    out.add((*g, part, item, -value, i + 1))
    return out


def check(spark, rows, least=3, top=4):
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int")
    got = audit(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, least, top)
    return found


def some_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Ärger", "ärger", "日本", "it's", "x1y", "z", "gamma", "delta"]
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "b", "ß", "hot", "hot", "hot", None])
        rows.append((rng.choice(["en", "en", "fr", None]), source, " ".join(rng.choices(words[: 4 + len(source or "")], k=rng.randint(0, 30)))))
    return rows


def test_against_brute_force(spark):
    found = check(spark, some_rows(120) + [("en", "empty", ""), ("en", "none", None), ("xx", "s", "rare"), ("xx", "t", None), ("yy", "alone", "word " * 9)])
    assert ("xx", "s", "pair", "t", 0, 1) in found


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 2)
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    check(spark, some_rows(80, seed=2), top=2)


def test_ties_and_repeats(spark):
    check(spark, [("en", s, "b a c") for s in "xyz" for _ in range(2)] + [("en", "w", "c d d"), ("en", "w", "d a"), ("en", "w", "d")])


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert audit(docs).collect() == []


@pytest.mark.parametrize("scale", [1, 10**6, 10**14])
def test_shares_are_exact(spark, scale):
    rng = random.Random(3)
    counts = np.array([[rng.randint(0, 9) * scale + rng.randint(0, 3) for _ in range(6)] for _ in range(5)])
    total = counts.sum(axis=1) + 7
    got = shares(counts, total, 6)
    want = [[1 + 10**9 * (int(c) + 5) // (int(t) + 30) for c in row] for row, t in zip(counts, total)]
    assert got.tolist() == want
    rows = spark.createDataFrame([(int(c), int(t)) for row, t in zip(counts, total) for c in row], "c long, t long")
    native = [r[0] for r in rows.selectExpr("c", "t", "6L AS v").select(divergence.share("c", "t", "v")).collect()]
    assert native == [x for row in want for x in row]


def test_terms():
    assert terms_of("It's Ünder_Score x2Y\x00ÉÉ".encode()) == [w.encode() for w in ("it", "s", "Ünder", "score", "x", "y", "ÉÉ")]
