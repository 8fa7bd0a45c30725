"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Documents are counted in tasks, as occurrences and documents of each (language, source, term), and added up.  A language keeps the
terms of enough of its documents.  A group (language, source) and a language as a whole give each kept term the share
p = 1 + floor(SHARE * (count + PRIOR) / (N + PRIOR * V)), N occurrences of the V kept terms; all arithmetic is in integers.

Pairs of sources are compared in a cube: the groups of a language fall into blocks of about GROUPS, its kept terms into
blocks of about TERMS.  A slice (group block, term block) holds the counts of its groups; it is packed once and sent to every cell
(group block, group block, term block) that it belongs to.  A cell adds up |p - q| of its pairs of groups over its
terms, and the sums are added along the term axis.  So no task holds a whole group, and none more than two slices.

Rules: null texts, languages and sources are read as ''.  A group without kept terms still has shares, all of them from the prior.
Without kept terms in a language all its distances are 0.  Repeated rows count each.  Ids and other columns are not used.
Equal values rank by the UTF-8 order of their items.  The counts of a language must add up to less than 2**53.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, unpack
from sheaf.llm.common import parts_for
from sheaf.llm.tables import written
from sheaf.operators.sizes import small_side

SHARE = 1_000_000_000
PRIOR = 5
GROUPS = 32
TERMS = 4096
HELD_TERMS = 400_000  # counted terms that a task holds before it sends them on, about 100 MB
HELD_BYTES = 1 << 20
ROW_BYTES = 16 << 20

# letters and everything outside ASCII make terms; A to Z are folded
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split()


def _count():
    """Documents (lang, source, text) → lang, source, term, n occurrences, d documents, of some of the rows."""
    names = ["lang", "source", "term", "n", "d"]

    def flush(held):
        for (lang, source), (n, d) in held.items():
            words = list(n)
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([n[w] for w in part], pa.int64()), pa.array([d[w] for w in part], pa.int64())], names=names)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for key, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                n, d = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                words = terms_of(text.as_py())
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > HELD_TERMS:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return run


def share(count: str, total: str, terms: str) -> Column:
    """The share of a term with ``count`` of ``total`` occurrences among ``terms`` kept terms, exactly."""
    over = f"cast({SHARE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))"
    return F.expr(f"1 + ({over}) div cast({total} + {PRIOR} * {terms} as decimal(20,0))")


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The shares of a matrix of counts [groups, terms], exactly: SHARE is three digits of 1000."""
    below = (total + PRIOR * terms)[:, None]
    out, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), over all documents."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count(), "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _pack_slices():
    """The groups of a slice with their counts (null column: a group without any) → one blob."""

    def run(key, table):
        sources = sorted(set(table.column("source").to_pylist()))
        row_of = {s: i for i, s in enumerate(sources)}
        rows = np.array([row_of[s] for s in table.column("source").to_pylist()], np.int64)
        total = np.zeros(len(sources), np.int64)
        total[rows] = table.column("total").to_numpy()
        entry = table.filter(table.column("col").is_valid())
        entry_rows = np.array([row_of[s] for s in entry.column("source").to_pylist()], np.int64)
        blob = pack(total, entry_rows, entry.column("col").to_numpy().astype(np.int64), entry.column("n").to_numpy().astype(np.int64))
        out = {n: pa.array([k.as_py()]) for n, k in zip(("lang", "g", "t"), key)}
        return pa.table({
            "lang": out["lang"].cast(pa.string()), "g": out["g"].cast(pa.int32()), "t": out["t"].cast(pa.int32()),
            "width": pa.array([table.column("width")[0].as_py()], pa.int32()), "terms": pa.array([table.column("terms")[0].as_py()], pa.int64()),
            "sources": pa.array([sources], pa.list_(pa.string())), "blob": pa.array([blob], pa.binary())})

    return run


def _slice_shares(row) -> np.ndarray:
    total, rows, columns, n = unpack(row["blob"])
    counts = np.zeros((len(total), row["width"]), np.int64)
    counts[rows, columns] = n
    return shares(counts, total, row["terms"])


def _cell():
    """One or two slices of a cell → the partial distance of each of its pairs of sources."""

    def run(key, table):
        found = {r["g"]: r for r in table.to_pylist()}
        a, b = (found.get(key[i].as_py()) for i in (1, 2))
        left, right, value = [], [], []
        if a and b:  # a block may have no groups
            p = _slice_shares(a)
            q = p if b is a else _slice_shares(b)
        for i, source in enumerate(a["sources"] if a and b else []):
            distance = np.abs(q - p[i]).sum(axis=1)
            first = i + 1 if b is a else 0
            left += [source] * (len(distance) - first)
            right += b["sources"][first:]
            value.append(distance[first:])
        n = len(left)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * n, pa.string()), "source": pa.array(left, pa.string()),
            "item": pa.array(right, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})

    return run


def _blocks(size: str, each: int) -> str:
    return f"greatest(1, ceil({size} / {each}))"


def audit(docs: DataFrame, min_documents: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has each other source of the language and its distance, part ``term`` the
    ``top_terms`` kept terms that the source uses more than its language does, with the excess of their shares."""
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = written(count_terms(read), "term-counts")
    found = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("documents"))
    found = written(found.filter(F.col("documents") >= min_documents).drop("documents"), "kept-terms")
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    # every group that occurs, and its occurrences of kept terms
    counts = written(counted.select("lang", "source", "term", "n").join(small_side(found), ["lang", "term"]), "kept-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.max("terms").alias("terms"))
    sizes = written(sizes.select("lang", F.expr(f"cast({_blocks('groups', GROUPS)} as int) AS group_blocks"), F.expr(f"cast({_blocks('terms', TERMS)} as int) AS term_blocks")), "sizes")
    pairs = _pairs(spark, counts, groups, found, small_side(sizes))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = counts.join(small_side(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    terms = terms.filter("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", order.alias("rank"))
    return part(both, "pair").unionByName(part(terms, "term").filter(F.col("rank") <= top_terms))


def _pairs(spark, counts, groups, found, sizes) -> DataFrame:
    """lang, source, item, value of each unordered pair of sources."""
    g = F.expr("cast(pmod(xxhash64(source), group_blocks) as int) AS g")
    t = F.expr("cast(pmod(xxhash64(term), term_blocks) as int) AS t")
    # a term's column is its place in its block
    column = F.row_number().over(Window.partitionBy("lang", "t").orderBy("term")) - 1
    columns = written(found.join(sizes, "lang").select("lang", "term", t).withColumn("col", column), "columns")
    widths = columns.groupBy("lang", "t").agg(F.count(F.lit(1)).cast("int").alias("width"))
    placed = groups.join(sizes, "lang").select("lang", "source", "total", "terms", g, "group_blocks")
    # each group is in each slice of its language, though it may have no terms there
    present = placed.join(widths, "lang").withColumns({"col": F.lit(None).cast("int"), "n": F.lit(None).cast("long")})
    entries = (
        counts.select("lang", "source", "term", "n").join(small_side(columns), ["lang", "term"]).join(small_side(placed), ["lang", "source"]).join(widths, ["lang", "t"])
    )
    slots = ["lang", "g", "t", "source", "total", "terms", "width", "col", "n"]
    rows = present.select(*slots).unionByName(entries.select(*slots))
    packed = rows.groupBy("lang", "g", "t").applyInArrow(
        _pack_slices(), "lang string, g int, t int, width int, terms long, sources array<string>, blob binary")
    slices = written(packed, "slices").join(sizes, "lang")
    other = F.explode(F.expr("sequence(0, group_blocks - 1)"))
    cells = slices.withColumn("other", other).withColumns({"a": F.least("g", "other"), "b": F.greatest("g", "other")})
    parts = parts_for(spark, cells.agg(F.sum(F.octet_length("blob"))).first()[0] or 0, ROW_BYTES)
    partial = cells.repartition(parts, "lang", "a", "b", "t").groupBy("lang", "a", "b", "t").applyInArrow(_cell(), "lang string, source string, item string, value long")
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # a language without kept terms has no slices; its distances are 0
    bare = groups.filter("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    return summed.unionByName(none)
