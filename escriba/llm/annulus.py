"""Centroid clustering of integer vectors, nearest centroids found by annulus search.

Centroids are sorted by their norms. A vector's distance to the centroid of the nearest norm is an upper bound u; as two points are at least as far
apart as their norms, only centroids whose norms lie within u of the vector's own can be nearer. Two binary searches cut that annulus out of the sorted
norms, and its centroids are compared exactly, in integers, those on its boundary included (the searched interval is wider than u by more than any rounding).

Vectors stay where they are: a round reads the table, assigns in tasks and sends one row for each cluster and component of a task, summed again by Spark
before the shuffle. The driver sees the centroids only.

Defined results: vectors that are null, of another size, or hold a null or a component that isn't finite take no part. Repeated rows are vectors each. Rows
without a vec_id take part, but start no centroid while there are others; among rows of one vec_id the smaller vector starts first. With fewer vectors than
centroids there are fewer centroids; an empty table has no rows. Other columns are neither read nor returned. Integers beyond 2^61 count as 2^61, and
distances or inertias that a long can't hold are the largest long; comparisons and sums are exact in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

CENTROIDS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
MOST = 1 << 61
_LONG = (1 << 63) - 1
#: Components whose sizes add up to less have squared distances that fit 64 bits.
_EXACT_64 = 1 << 28


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are vectors of that size with finite components only: their numbers, and a matrix of doubles."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, size))
    if pa.types.is_null(column.type):
        column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    if not len(rows) or not size:
        return np.zeros(0, np.int64), np.zeros((0, size))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    found = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    good = np.isfinite(found).all(axis=1)
    return rows[good], found[good]


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), at most MOST in size."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -float(MOST), float(MOST)).astype(np.int64)


class Annulus:
    """Centroids (integers, a row each) in order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.centroids = centroids[self.order]
        self.largest = int(np.abs(centroids).max(initial=0))

    def _squared(self, x: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Exact squared distances of rows of x to centroid k (of the sorted ones), or each row's own."""
        c = self.centroids[k]
        if self.largest + int(np.abs(x).max(initial=0)) < _EXACT_64:
            d = x - c
            return np.einsum("ij,ij->i", d, d)
        return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid (the smaller of equally near ones) and the squared distance."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        above = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        pivot = np.where(np.abs(self.norms[below] - norm) <= np.abs(self.norms[above] - norm), below, above)
        squared = self._squared(x, pivot)
        best = self.order[pivot]
        # wider than the bound by more than the roundings of the norms and of the root
        reach = np.sqrt(squared.astype(np.float64)) * (1 + 1e-9) + 1e-9 * (norm + self.norms[-1]) + 1e-6
        first = np.searchsorted(self.norms, norm - reach, "left")
        end = np.searchsorted(self.norms, norm + reach, "right")
        for k, number in enumerate(self.order):
            rows = np.flatnonzero((first <= k) & (k < end) & (pivot != k))
            if len(rows):
                d = self._squared(x[rows], k)
                nearer = (d < squared[rows]) | ((d == squared[rows]) & (number < best[rows]))
                rows, d = rows[nearer], d[nearer]
                squared[rows], best[rows] = d, number
        return best, squared


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """cluster, part (component), n and total: the vectors of each cluster, summed by task."""
    ring, size = Annulus(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = whole(matrix(batch.column(0), size)[1], scale)
            if len(x):
                to = ring.nearest(x)[0]
                n += np.bincount(to, minlength=k)
                np.add.at(high, to, x >> 31)
                np.add.at(low, to, x & ((1 << 31) - 1))
        used = np.flatnonzero(n)
        totals = [(int(h) << 31) + int(v) for c in used for h, v in zip(high[c], low[c], strict=True)]
        yield pa.record_batch({"cluster": pa.array(np.repeat(used, size), pa.int32()), "part": pa.array(np.tile(np.arange(size), len(used)), pa.int32()), "n": pa.array(np.repeat(n[used], size), pa.int64()), "total": pa.array(totals, pa.decimal128(38, 0))})

    return vectors.select("embedding").mapInArrow(run, "cluster int, part int, n long, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def start(vectors: DataFrame, centroids: int = CENTROIDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), size)
            flat = pa.array(whole(x, scale).ravel(), pa.int64())
            yield pa.record_batch({"key": batch.column(0).take(pa.array(rows)), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), flat)})

    found = vectors.select(key.alias("key"), "embedding").mapInArrow(run, "key string, x array<bigint>").orderBy(F.col("key").asc_nulls_last(), "x").limit(centroids).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), size)


def fit(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids after so many rounds of assigning vectors (vec_id, embedding) and taking floored means; empty ones stay."""
    found = start(vectors, centroids, size, scale, seed)
    for _ in range(rounds if len(found) else 0):
        for r in _sums(vectors, found, scale).collect():  # a row for each centroid and component
            found[r["cluster"], r["part"]] = int(r["total"]) // r["n"]
    return found


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    ring, size = Annulus(centroids) if len(centroids) else None, centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), size)
            if ring is not None and len(rows):
                to, squared = ring.nearest(whole(x, scale))
                if squared.dtype == object:
                    squared = np.minimum(squared, _LONG).astype(np.int64)
                yield pa.record_batch({"vec_id": batch.column(0).take(pa.array(rows)), "cluster": pa.array(to, pa.int32()), "distance": pa.array(squared, pa.int64())})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def report(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector: its cluster, the squared distance, the sums of distances over the cluster and over all, and a digest of the cluster's centroid."""
    spark = vectors.sparkSession
    final = fit(vectors, centroids, rounds, size, scale, seed)
    assigned = frames.cut(assign(vectors, final, scale))
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    told = [(k, min(inertia.get(k, 0), _LONG), min(sum(inertia.values()), _LONG), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(final)]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), e) - 1 as k, e from v qualify k < {centroids})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{i} as materialized (select vec_id, e, r.k, r.d from (select v.vec_id, v.e, min(struct_pack(d := cast({distance} as bigint), k := c.k)) as r from v, c{i} c group by all) x)")
        if i < rounds:
            mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
            parts.append(f"m{i} as (select k, list({mean} order by pos) as e from (select k, pos, cast(sum(x) as hugeint) as s, cast(count(*) as hugeint) as n from (select k, unnest(e) as x, unnest(range(1, {size + 1})) as pos from a{i}) u group by k, pos) t group by k)")
            parts.append(f"c{i + 1} as materialized (select c.k, coalesce(m.e, c.e) as e from c{i} c left join m{i} m on m.k = c.k)")
    return f"""with {", ".join(parts)} select vec_id, cast(a.k as int) as cluster, d as distance, cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
 sha256(array_to_string(c.e, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.k = a.k"""


#: report in DuckDB's SQL, for tables whose vec_id are distinct.
ORACLE_SQL = _sql()
