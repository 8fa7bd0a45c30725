"""Exact top-k search by inner product: distributed histogram selection.

Every query is scored against every other row, in blocks.  The first pass counts scores per query in
BINS wide bins between bounds that follow from the vectors' lengths; each further pass counts anew
within the bin that holds the k-th best score, until a bin is one score wide.  Then the k-th value is
known, and a last pass keeps what lies above it and, of the scores equal to it, the smallest ids.  Only
histograms and the final few rows per query are exchanged; histograms of one task are summed before.

Components are taken as floor(scale * x).  Rules: a vector that is null or empty, or holds a null or a component
that is not finite, or whose id is null, takes no part.  Vectors are compared with those of equal length only.  Repeated rows of
one id and vector ask once, but each row is a candidate; no query meets rows of its own id.  Ids that
ask with several vectors get one ranking per vector.  Scaled components must be below 2**53; the inner products
are computed exactly, in 64-bit integers where float arithmetic would round, and must fit them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, unpack
from sheaf.llm.common import parts_for, small_batches
from sheaf.llm.tables import written

BINS = 128
QUERY_BLOCK = 512
ROW_BLOCK = 1024
GROUP_BLOCKS = 64

_FLOAT_EXACT = 2**53


def _blocks(size: int):
    """Rows (id, vector) of one partition → blobs of up to ``size`` vectors of equal length."""

    def run(batches):
        held = {}

        def flush(width):
            ids, vectors = held.pop(width)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([pack(np.array(ids, np.int64), np.concatenate(vectors))], pa.binary())], names=["width", "blob"])

        for batch in batches:
            column = batch.column("vector")
            at = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (a, b) in zip(batch.column("id").to_pylist(), zip(at[:-1], at[1:])):
                ids, vectors = held.setdefault(int(b - a), ([], []))
                ids.append(i)
                vectors.append(values[a:b])
                if len(ids) == size:
                    yield flush(int(b - a))
        for width in list(held):
            yield flush(width)

    return run


def _matrix(blob) -> tuple[np.ndarray, np.ndarray]:
    ids, flat = unpack(blob)
    return ids, flat.reshape(len(ids), -1)


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products [queries, rows]."""
    most = q.shape[1] * int(np.abs(q).max()) * int(np.abs(rows).max())
    if most < _FLOAT_EXACT:
        return (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    return q @ rows.T


def _counts():
    """Pairs of blocks → for each query block the histogram of scores in each query's range."""
    names = ["block", "hist"]

    def run(batches):
        total = {}
        for batch in batches:
            for block, q_blob, r_blob, state in zip(*(batch.column(c).to_pylist() for c in ("block", "queries", "rows", "state"))):
                ids, q = _matrix(q_blob)
                others, rows = _matrix(r_blob)
                low, span, _ = (a[:, None] for a in unpack(state))
                beyond = _scores(q, rows) - low
                inside = (beyond >= 0) & (beyond < span) & (ids[:, None] != others[None, :])
                bin_of = beyond // -(-span // BINS)
                cell = (np.arange(len(ids))[:, None] * BINS + bin_of)[inside]
                hist = np.bincount(cell, minlength=len(ids) * BINS).astype(np.int64)
                total[block] = total.get(block, 0) + hist
        for block, hist in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(hist)], pa.binary())], names=names)

    return run


def _narrow():
    """Histograms of one query block → each query's next range and how many scores lie above it."""

    def run(key, table):
        state = table.column("state").to_pylist()[0]
        low, span, wanted = unpack(state)
        width = -(-span // BINS)
        hist = sum(unpack(h)[0] for h in table.column("hist").to_pylist() if h is not None)
        if isinstance(hist, int):  # no candidates at all
            hist = np.zeros(len(low) * BINS, np.int64)
        hist = hist.reshape(len(low), BINS)
        above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
        enough = above >= wanted[:, None]
        found = enough.any(axis=1)
        bin_of = np.where(found, BINS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        beyond = np.where(bin_of + 1 < BINS, np.take_along_axis(above, np.minimum(bin_of + 1, BINS - 1)[:, None], 1)[:, 0], 0)
        wanted = np.where(found, wanted - beyond, wanted)  # fewer rows than k: the lowest bin, so all are kept
        span = np.minimum(width, span - bin_of * width)
        return pa.table({"block": pa.array([key[0].as_py()]), "state": pa.array([pack(low + bin_of * width, span, wanted)], pa.binary())})

    return run


def _bounds(k: int):
    """A query block → the range that must hold all its scores, by the lengths of the vectors."""

    def run(batches):
        for batch in batches:
            states = []
            for blob, most in zip(batch.column("queries").to_pylist(), batch.column("longest").to_pylist()):
                _, q = _matrix(blob)
                reach = np.ceil(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt(most) * (1 + 1e-9)).astype(np.int64) + 1
                states.append(pack(-reach, 2 * reach + 1, np.full(len(q), k, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(states, pa.binary())], names=["block", "state"])

    return run


def _keep():
    """Pairs of blocks → the rows at or above each query's k-th value."""

    def run(batches):
        for batch in batches:
            for block, q_blob, r_blob, state in zip(*(batch.column(c).to_pylist() for c in ("block", "queries", "rows", "state"))):
                ids, q = _matrix(q_blob)
                others, rows = _matrix(r_blob)
                low, _, wanted = unpack(state)
                scores = _scores(q, rows)
                hit = (scores >= low[:, None]) & (ids[:, None] != others[None, :])
                # of the scores equal to the k-th value, no block needs more than k of the smallest ids
                order = np.argsort(others, kind="stable")
                tied = (hit & (scores == low[:, None]))[:, order]
                spare = tied & (np.cumsum(tied, axis=1) > wanted[:, None])
                hit[:, order] &= ~spare
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), block)), pa.array(i.astype(np.int64)), pa.array(ids[i]), pa.array(others[j]), pa.array(scores[i, j])],
                    names=["block", "slot", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to smaller ids.

    ``is_query`` is a condition over the id, as column ``id``.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col(vector_column)
    valid = F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    rows = vectors.filter(valid & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), whole.alias("vector"))
    rows = written(rows, "vectors")
    longest = F.max(F.aggregate(F.transform("vector", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)).alias("longest")
    longest = rows.groupBy(F.size("vector").alias("width")).agg(longest)
    blobs = "width int, blob binary"
    number = F.monotonically_increasing_id()
    queries = rows.filter(is_query).dropDuplicates(["id", "vector"]).mapInArrow(_blocks(QUERY_BLOCK), blobs)
    queries = queries.withColumn("block", number).withColumnRenamed("blob", "queries")
    queries = written(queries.join(longest, "width"), "queries")
    candidates = rows.mapInArrow(_blocks(ROW_BLOCK), blobs).withColumnRenamed("blob", "rows").withColumn("number", number)
    candidates = written(candidates, "candidates")
    groups = parts_for(spark, candidates.count(), GROUP_BLOCKS)
    candidates = candidates.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    # every group of row blocks meets all query blocks of its width
    asked = queries.select("width", "block", "queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    state = queries.mapInArrow(_bounds(k), "block long, state binary")
    span = 2 * _reach(longest) + 1
    while True:
        state = written(state, "state")
        pairs = asked.join(state, "block").join(candidates, ["width", "group"])
        if span == 1:
            break
        hist = pairs.mapInArrow(_counts(), "block long, hist binary")
        state = state.join(hist, "block", "left").groupBy("block").applyInArrow(_narrow(), "block long, state binary")
        span = -(-span // BINS)
    found = pairs.mapInArrow(_keep(), "block long, slot long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(longest: DataFrame) -> int:
    """A bound of every score."""
    most = longest.agg(F.max("longest")).first()[0] or 0.0
    return int(most) + 2
