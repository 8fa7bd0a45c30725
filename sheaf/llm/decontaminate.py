"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of words the minimum hash of its k-grams, the leftmost of equal ones, is its fingerprint.  Neighbouring windows mostly share it, so a
text keeps one where the minimum moves: about one in five words.  Equal windows have equal fingerprints at equal offsets, so the fingerprints of the
documents are joined with those of the benchmark's windows, and each hit is extended: the words around it are compared with the whole window.  With
windows of WINDOW words and k-grams of GRAM words, every shared run of at least WINDOW words is found.  An item of fewer words is one window of its own
length, with k-grams no longer than itself.

The fingerprints of the documents are written once, as narrow rows without words.  Only texts that share a fingerprint are read again, each once,
however many documents hold it.  Items of a window are rows, not lists.  A side is broadcast if its measured size is small; else the join shuffles, and
Spark splits a skewed fingerprint.

Rules: a null or empty text has no words and no hits, and an item without words has no windows.  Items with
a null id mark words as hit but are not listed.  Repeated documents each get their row; repeated items
count once per id.  Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import whole_row
from sheaf.llm.tables import written
from sheaf.operators.sizes import small_side

WINDOW, GRAM = 13, 5

_PLACE = 2**31 - 1  # the lower bits of a marked gram hold its place, the others its hash

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A to Z) words of letters, digits and characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def _runs(of: str, n: Column, k: int) -> Column:
    """The first elements of all runs of k elements."""
    return F.slice(F.col(of), 1, F.greatest(n - (k - 1), F.lit(0)))


def _grams(hashes: str, n: Column, k: int) -> Column:
    """Hashes of all k-grams."""
    return F.transform(_runs(hashes, n, k), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, k))))


def _marked(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``marked{k}`` for the gram lengths k that windows of these lengths need: hashes of all k-grams, with their places."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for k in sorted({min(GRAM, length) for length in lengths}):
        mark = lambda g, i: g.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
        rows = rows.withColumn(f"marked{k}", F.transform(_grams("hashes", F.size("words"), k), mark))
    return rows


def _minima(length: int) -> Column:
    """For each window of ``length`` words its least marked gram."""
    k = min(GRAM, length)
    span, marked = length - k + 1, f"marked{k}"
    return F.transform(_runs(marked, F.size(marked), span), lambda x, i: F.array_min(F.slice(F.col(marked), i + 1, F.lit(span))))


def _place(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(_PLACE)).cast("int")


def _hash(mark: Column) -> Column:
    return F.shiftright(mark, 31)


def _window_of(length: int):
    """A window's minimum and its start → its fingerprint and words."""

    def window(m: Column, i: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), _hash(m).alias("print"), (_place(m) - i).alias("offset"), F.slice("words", i + 1, F.lit(length)).alias("test"))

    return window


def _winnowed(minima: str, length: int) -> Column:
    """The fingerprints (length, print, at) of a text: one where the minimum moves."""

    def moves(m: Column, i: Column) -> Column:
        return (i == 0) | (m != F.get(F.col(minima), i - 1))

    def fingerprint(m: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), _hash(m).alias("print"), _place(m).alias("at"))

    return F.transform(F.filter(minima, moves), fingerprint)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of the benchmark (id, length, print, offset, test), and the items that hold them (id, item)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("own", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r.own for r in items.select("own").distinct().collect())  # at most WINDOW values
    rows = _marked(items, lengths or [WINDOW])
    found = []
    for length in lengths or [WINDOW]:
        found.append(F.when(F.col("own") == length, F.transform(_minima(length), _window_of(length))))
    # outer: no filter on the array is inferred, which would be pushed below all of its steps and repeat them
    one = rows.withColumn("found", F.coalesce(*found)).select("item", F.inline_outer("found")).filter(F.col("print").isNotNull())
    named = written(one.withColumn("id", F.sha2(F.concat_ws(" ", "length", F.array_join("test", " ")), 256)), "windows")
    return named.drop("item").dropDuplicates(["id"]), named.filter("item IS NOT NULL").select("id", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` (text and the columns ``carry``): n_words, n_hit, items (sorted), hits (at, length)."""
    windows, items = benchmark_windows(benchmark)
    windows, items = written(windows, "windows"), written(items, "items")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most WINDOW values
    rows = docs.select(F.struct(*carry).alias("carry"), _text_key("text"), words_of(F.col("text")).alias("words"))
    rows = _marked(rows, lengths or [WINDOW])
    kept = []
    for length in lengths or [WINDOW]:
        minima = f"minima{length}"
        rows = rows.withColumn(minima, _minima(length))
        kept.append(_winnowed(minima, length))
    rows = written(rows.select("carry", "key", F.size("words").cast("long").alias("n_words"), F.concat(*kept).alias("prints")), "prints")
    known = written(windows.select("length", "print").distinct(), "wanted")
    met = rows.select("key", F.inline("prints")).join(small_side(known), ["length", "print"], "left_semi")
    met = written(met.groupBy("key").agg(F.collect_set(F.struct("length", "print", "at")).alias("met")), "met")
    hits = written(_extended(docs, met, windows), "hits")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("hits"))
    listed = hits.select("key", "id").distinct().join(small_side(items), "id").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = written(spans.join(listed, "key", "left").withColumn("n_hit", F.size(covered).cast("long")), "facts")
    out = rows.select("carry", "key", "n_words").join(small_side(facts), "key", "left")
    return out.select(
        *[F.col(f"carry.`{c}`") for c in carry], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<struct<at:int,length:int>>")).alias("hits"))


def _text_key(text: str) -> Column:
    """What texts are told apart by; their ids do not matter."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key")


def _extended(docs: DataFrame, met: DataFrame, windows: DataFrame) -> DataFrame:
    """key, at, length, id: the windows that stand in the texts, each fingerprint extended by the words around it."""
    texts = docs.select(_text_key("text"), "text").join(small_side(met), "key").dropDuplicates(["key"])
    texts = texts.select("key", "met", words_of(F.col("text")).alias("words"))

    def around(m: Column) -> Column:
        # a window that holds the k-gram begins at most length - k words before it
        reach = m["length"] - F.least(m["length"], F.lit(GRAM))
        first = F.greatest(m["at"] - reach, F.lit(0))
        return F.struct(m["length"].alias("length"), m["print"].alias("print"), m["at"].alias("place"), first.alias("first"),
                        F.slice(F.col("words"), first + 1, m["at"] + m["length"] - first).alias("near"))

    near = texts.select("key", F.inline_outer(F.transform("met", around)))
    start = F.col("place") - F.col("offset")
    same = F.slice("near", start - F.col("first") + 1, F.col("length")) == F.col("test")
    tested = near.join(small_side(windows), ["length", "print"]).where((start >= F.col("first")) & same)
    return tested.select("key", start.alias("at"), "length", "id").distinct()


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of ``docs`` (whole) that are not contaminated."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id")
    keyed = docs.select(whole_row(docs), ident, F.xxhash64("text").alias("_key"))
    found = contamination(keyed.select("_id", "_key", F.col("rest.text").alias("text")), benchmark, ("_id", "_key"))
    found = written(found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"), share)).select("_id", "_key").distinct(), "contaminated")
    return keyed.join(found, ["_id", "_key"], "left_anti").select("rest.*")


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Whether at least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)
