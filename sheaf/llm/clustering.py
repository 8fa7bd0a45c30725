"""Centroid clustering of integer vectors, with Ptolemaic pivots in place of most distances.

PIVOTS fixed vectors are chosen once, far from each other, and each vector's distance to each of them is kept with it.  For a vector x, a
centroid c and pivots p, q Ptolemy's inequality gives

    d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|

so the kept distances and the few between centroids and pivots bound d(x, c) from below.  A vector's exact distance to the centroid
of the least bound comes first; any other centroid whose bound does not exceed the best distance so far is checked exactly.  Bounds are
rounded down by more than floating point can err, so no centroid is passed over that could be nearest or tie.

Vectors lie in blocks in the shared folder, with their pivot distances.  A round is one pass over them; tasks add up the vectors of each
cluster, Spark adds those sums, and only k times width numbers reach the driver.

Components are taken as floor(scale * x).  Rules: a vector that is null, has not ``width`` components, or holds a null or a
component that is not finite takes no part; nor does one with a scaled component of 2**52 or more, which doubles no longer hold exactly.
Null ids are clustered, but never start a cluster.  Repeated rows each count; those of one id start clusters in the order of their components.
With fewer vectors than clusters, each starts one.  Distances and sums that do not fit 64 bits are null.  Other columns are not used.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.blobs import pack, unpack
from sheaf.llm.tables import written

PIVOTS = 6
PIVOT_CANDIDATES = 64
BLOCK = 2048
LARGEST = 2**52  # scaled components must be smaller
_SLACK = 1e-9
_NARROW = 2**26  # below, squared distances of up to 2**8 components fit 64 bits
_DECIMAL = pa.decimal128(38, 0)


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances; Python integers where 64 bits may not do."""
    apart = rows - point
    if len(apart) and max(int(apart.max()), -int(apart.min())) >= 2 * _NARROW or rows.shape[1] > 256:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1)


def lengths(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances [rows, points] in floating point, from exact squares."""
    return np.sqrt(np.stack([squares(rows, p).astype(np.float64) for p in points], axis=1))


class Nearest:
    """Finds the nearest centroid, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.to_pivots = lengths(centroids, pivots)
        between = lengths(pivots, pivots)
        self.pairs = [(a, b, between[a, b]) for a, b in combinations(range(len(pivots)), 2) if between[a, b] > 0]
        self.checked = 0

    def bounds(self, pivot_distances: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances [rows, centroids]."""
        low = np.zeros((len(pivot_distances), len(self.centroids)))
        for a, b, apart in self.pairs:
            x = pivot_distances[:, a, None] * self.to_pivots[:, b]
            y = pivot_distances[:, b, None] * self.to_pivots[:, a]
            np.maximum(low, (np.abs(x - y) - (x + y) * _SLACK) / apart, out=low)
        return low * low * (1 - _SLACK)

    def __call__(self, rows: np.ndarray, pivot_distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, exact squared distance) of each row."""
        low = self.bounds(pivot_distances)
        first = np.argmin(low, axis=1)
        found = [squares(rows[first == c], centroid) for c, centroid in enumerate(self.centroids)]
        cluster, best = first.copy(), np.zeros(len(rows), np.result_type(*found))
        for c, distance in enumerate(found):
            best[first == c] = distance
        self.checked += len(rows)
        for c, centroid in enumerate(self.centroids):
            at = np.flatnonzero((low[:, c] <= best.astype(np.float64) * (1 + _SLACK)) & (first != c))
            self.checked += len(at)
            distance = squares(rows[at], centroid)
            nearer = (distance < best[at]) | ((distance == best[at]) & (c < cluster[at]))
            cluster[at[nearer]], best[at[nearer]] = c, distance[nearer]
        return cluster, best


def choose_pivots(candidates: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` of the candidates: the first, then always the one farthest from those chosen."""
    chosen = [0]
    near = squares(candidates, candidates[0]).astype(np.float64)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(candidates, candidates[chosen[-1]]).astype(np.float64))
    return candidates[chosen]


def _blocks(pivots: np.ndarray):
    """Rows (id, vector) → blocks of vectors with their pivot distances."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column("id")
                rows = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                blob = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, rows.ravel(), lengths(rows, pivots).ravel())
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    return run


def _read(blob):
    ids, known, rows, to_pivots = unpack(blob)
    return ids, known, rows.reshape(len(ids), -1), to_pivots.reshape(len(ids), -1)


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Blocks → of each cluster, the number and the sum of a task's vectors."""

    def run(batches):
        nearest = Nearest(centroids, pivots)
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, _, rows, to_pivots = _read(blob)
                cluster, _ = nearest(rows, to_pivots)
                for c in np.unique(cluster):
                    mine = rows[cluster == c]
                    total[c] += mine.sum(axis=0)  # 2**11 components below 2**52
                    count[c] += len(mine)
        used = np.flatnonzero(count)
        sums = pa.array([[int(x) for x in total[c]] for c in used], pa.list_(_DECIMAL))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), sums], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray):
    """Blocks → id, cluster, distance."""

    def run(batches):
        nearest = Nearest(centroids, pivots)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                ids, known, rows, to_pivots = _read(blob)
                cluster, distance = nearest(rows, to_pivots)
                columns = [pa.array(ids, mask=known == 0), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), _DECIMAL)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return run


def _moved(blocks: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""
    tasks = blocks.mapInArrow(_sums(centroids, pivots), "cluster int, n long, sums array<decimal(38,0)>")
    summed = tasks.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for row in summed.collect():  # k times width rows
        out[row.cluster, row.i] = int(row.x) // row.n
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: str = "1", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector.

    The first centroids are the vectors whose sha256 of "seed:id" is least.  ``centroid_sha256`` is of the final centroid's components
    in decimal, joined by commas.
    """
    spark = vectors.sparkSession
    x = F.col(vector_column)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v.cast("double")) < LARGEST / scale, F.floor(v.cast("double") * F.lit(float(scale)))))
    rows = vectors.filter(x.isNotNull() & (F.size(x) == width) & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), whole.alias("vector"))
    rows = rows.filter(~F.exists("vector", lambda v: v.isNull()))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter("id IS NOT NULL").select(order.alias("order"), "vector").orderBy("order", "vector").limit(max(k, PIVOT_CANDIDATES)).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    candidates = np.array([r.vector for r in first], np.int64)
    centroids, pivots = candidates[:k], choose_pivots(candidates)
    blocks = written(rows.mapInArrow(_blocks(pivots), "blob binary"), "vector-blocks")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, pivots)
    assigned = written(blocks.mapInArrow(_assign(centroids, pivots), "id long, cluster int, distance decimal(38,0)"), "assigned")
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}  # k rows
    inertia = None if None in totals.values() else sum(totals.values())
    fits = lambda n: int(n) if n is not None and n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(total), fits(inertia), digest[c]) for c, total in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", F.col("distance").try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
