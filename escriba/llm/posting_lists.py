"""Approximate nearest neighbours by balanced posting lists.

Fitting, on a bounded sample: vectors are split into clusters again and again until none holds more than its share of the sample, so that lists are balanced; their centres are
the lists' centroids. A graph links every centroid to its nearest ones and is searched in memory, wherever centroids near a vector are wanted. Two ratios of distances
decide which lists count: a vector is written to its nearest list and, near a boundary, to others up to BOUNDARY times as far (unless a list it is already in lies nearer to
that list's centroid than the vector does), and a query reads the lists up to `ratio` times as far as its nearest. The ratio is the one that finds TARGET of the
neighbours within the sample.

Nearness is the largest inner product. Vectors get one more component that makes all norms equal, so that the nearest by distance is the largest by product; queries
get a zero there.

Searching: lists are cut into chunks, and small ones packed together, to blocks of about equal, bounded numbers of vectors; a list that holds a third of all vectors is
many blocks. The queries of a block are dealt to parts, too. A block and a part meet in one task, which sends back the best of each query; what is near the
last of them is computed again component by component, so equal vectors have equal scores wherever they are compared.

Bounds: the sample has at most SAMPLE rows and SAMPLE_BYTES, drawn by a hash of vec_id. Every row is indexed. The driver holds the sample, the centroids, and counts for each list.

Defined results: vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part, and neither do rows without a vec_id. Vectors are
compared with those of the same size only; there is an index for each size. Equal rows count once; rows of one vec_id with different vectors are candidates each, while
the smaller vector is the query, and none of them is a candidate of its own. An empty table has no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .annulus import matrix

SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
#: Lists number about the root of the rows, and hold so many rows of the sample at least.
SAMPLE_ROWS = 16
LINKS, ENTRIES = 24, 16
BOUNDARY, COPIES = 1.1, 4
TARGET, PROBES, NEAREST = 0.97, 512, 20
BLOCK_ROWS, BLOCKS, PART_ROWS = 8192, 64, 16_384


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1), 0))


def balanced(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of clusters of rows of x: the largest cluster is split in up to eight by a few rounds of k-means until each holds at most its share, len(x) / lists, and half again.

    A cluster of equal vectors stays whole."""
    rng = np.random.default_rng(seed)
    most = max(1, math.ceil(1.5 * len(x) / lists))
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        own = x[rows]
        if len(rows) <= most or (own == own[0]).all():
            done.append(own.mean(axis=0))
            continue
        ways = min(8, max(2, round(len(rows) * lists / len(x))))
        centres = own[rng.choice(len(rows), min(ways, len(rows)), replace=False)]
        weight = np.zeros(len(centres))
        for _ in range(12):
            cost = _distances(own, centres) ** 2 + weight
            to = cost.argmin(axis=1)
            n = np.bincount(to, minlength=len(centres))
            # clusters that have more than their share grow dearer
            weight += cost.min(axis=1).mean() * 0.3 * (n * len(centres) / len(rows) - 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, to, own)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        split = [rows[to == k] for k in range(len(centres)) if (to == k).any()]
        if len(split) == 1:  # by a plane through their middle, then
            at = own @ (own[np.argmax(_distances(own, own[:1]))] - own[0])
            split = [rows[at <= np.median(at)], rows[at > np.median(at)]]
            split = [s for s in split if len(s)] if min(map(len, split)) else [rows[at < at.max()], rows[at == at.max()]]
            if min(map(len, split)) == 0:
                done.append(own.mean(axis=0))
                continue
        todo += split
    return np.unique(np.array(done), axis=0)


class Graph:
    """Centroids and, for each, the numbers of its nearest ones and of its neighbours in a ring, by which every centroid can be reached."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        near = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")[:, 1 : LINKS + 1] if k > 1 else np.zeros((1, 0), np.int64)
        ring = (np.arange(k)[:, None] + np.array([1, k - 1])) % k
        self.links = np.concatenate([near, ring], axis=1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, ENTRIES)).astype(int))

    def search(self, x: np.ndarray, ratio: float, least: int = 1) -> np.ndarray:
        """Distances of rows of x to the centroids, infinite where the search saw no reason to look: from the entries on, it looks at the links of all centroids
        that are up to ratio times as far as the nearest seen, or among the nearest few."""
        seen = np.full((len(x), len(self.centroids)), np.inf)
        seen[:, self.entries] = _distances(x, self.centroids[self.entries])
        opened = np.zeros(seen.shape, bool)
        few = min(max(least, 8), seen.shape[1])
        squares, own = (self.centroids * self.centroids).sum(axis=1), (x * x).sum(axis=1)
        while True:
            bound = np.maximum(seen.min(axis=1) * ratio, np.partition(seen, few - 1, axis=1)[:, few - 1])
            now = (seen <= bound[:, None]) & ~opened & np.isfinite(seen)
            rows, at = np.nonzero(now)
            if not len(rows):
                return seen
            opened[rows, at] = True
            fresh = np.zeros(seen.shape, bool)
            fresh[np.repeat(rows, self.links.shape[1]), self.links[at].ravel()] = True
            fresh &= np.isinf(seen)
            for c in np.flatnonzero(fresh.any(axis=0)):  # a column of distances at once
                r = np.flatnonzero(fresh[:, c])
                seen[r, c] = np.sqrt(np.maximum(own[r] - 2 * (x[r] @ self.centroids[c]) + squares[c], 0))


@dataclass
class Index:
    size: int
    #: the largest norm
    scale: float
    graph: Graph
    ratio: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that makes norms 1."""
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def aim(self, x: np.ndarray) -> np.ndarray:
        """Rows as queries."""
        x = x / np.abs(x).max(axis=1)[:, None]
        return np.concatenate([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))], axis=1)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of x (lifted) and a list it belongs to."""
        seen = self.graph.search(x, BOUNDARY, COPIES)
        nearest = np.argsort(seen, axis=1, kind="stable")[:, :COPIES]
        d = np.take_along_axis(seen, nearest, axis=1)
        member = d <= BOUNDARY * d[:, :1]
        member[:, 0] = True
        centres = self.graph.centroids[nearest]
        for k in range(1, nearest.shape[1]):
            for j in range(k):
                apart = np.sqrt(((centres[:, k] - centres[:, j]) ** 2).sum(axis=1))
                member[:, k] &= ~member[:, j] | (d[:, k] <= apart)
        rows, k = np.nonzero(member)
        return rows, nearest[rows, k]

    def chosen(self, x: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of x (aimed) and a list that it reads: those within the ratio, and the nearest ones until they hold (held: rows of each list) at least so many rows."""
        seen = self.graph.search(x, self.ratio)
        order = np.argsort(seen, axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        reads = np.zeros(seen.shape, bool)
        np.put_along_axis(reads, order, before < least, axis=1)
        return np.nonzero(reads | (seen <= seen.min(axis=1)[:, None] * self.ratio + 1e-12))


def _blocks(n: int, most: int = 4 << 20) -> Iterator[slice]:
    step = max(1, most)
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def fit(sample: np.ndarray, rows: int, scale: float) -> Index:
    """An index for rows vectors, of which sample are some."""
    lists = max(1, min(round(math.sqrt(rows)), len(sample) // SAMPLE_ROWS))
    index = Index(sample.shape[1], scale, None, 1.0)  # type: ignore[arg-type]
    lifted = index.lift(sample)
    index.graph = Graph(balanced(lifted, lists))
    # of the probes' neighbours in the sample, how far away is the nearest list that holds them?
    probes = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), PROBES)).astype(int))
    aimed = index.aim(sample[probes])
    products = aimed[:, :-1] @ (sample / scale).T
    products[np.arange(len(probes)), probes] = -np.inf
    k = min(NEAREST, len(sample) - 1)
    if k:
        top = np.argpartition(-products, k - 1, axis=1)[:, :k]
        d = _distances(aimed, index.graph.centroids)
        member = np.zeros((len(sample), d.shape[1]), bool)
        for s in _blocks(len(sample), 8192):
            r, at = index.lists(lifted[s])
            member[s.start + r, at] = True
        needed = np.where(member[top], d[:, None, :], np.inf).min(axis=2) / np.maximum(d.min(axis=1), 1e-12)[:, None]
        index.ratio = float(np.quantile(needed, TARGET, method="higher"))
    return index


def _norm() -> Column:
    most = F.array_max(F.transform("embedding", F.abs))
    return most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) and size of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)).withColumn("size", F.size("embedding"))


def build(vectors: DataFrame) -> list[Index]:
    """An index for each size of vectors (usable)."""
    sizes = vectors.groupBy("size").agg(F.count("*").alias("n"), F.max(_norm()).alias("scale")).orderBy("size").collect()
    out = []
    for r in sizes:
        most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * r["size"])))
        share = int(min(1.0, most / r["n"]) * (1 << 40))
        drawn = vectors.where((F.col("size") == r["size"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < share)).select("embedding").limit(most).toArrow()
        x = matrix(drawn.column(0).combine_chunks(), r["size"])[1] if drawn.num_rows else np.zeros((0, r["size"]))
        if not len(x):  # none of a few was drawn
            x = matrix(vectors.where(F.col("size") == r["size"]).select("embedding").limit(most).toArrow().column(0).combine_chunks(), r["size"])[1]
        out.append(fit(x, r["n"], min(float(r["scale"]), 1.7e308)))
    return out


def _placed(rows: DataFrame, index: Index, held: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """vec_id, embedding, the lists that hold each row or, with the numbers of rows that lists hold, those it reads, and a number that deals out rows of one vec_id, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = matrix(batch.column(1), index.size)
            for s in _blocks(len(x), max(1, (4 << 20) // len(index.graph.centroids))):
                row, at = index.lists(index.lift(x[s])) if held is None else index.chosen(index.aim(x[s]), held, least)
                ends = np.searchsorted(row, np.arange(s.stop - s.start + 1))
                yield pa.record_batch({"vec_id": batch.column(0).take(pa.array(good[s])), "embedding": batch.column(1).take(pa.array(good[s])), "lists": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())), "dealt": pa.array(good[s], pa.int64())})

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, lists array<int>, dealt long")


def deal(held: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list its first block, how many blocks it has, and how many parts its queries make. held, read: vectors and queries of each list. Lists share a block only if
    all of it is one block and one part."""
    most = max(1, min(BLOCK_ROWS, math.ceil(held.sum() / BLOCKS)))
    first = np.zeros(len(held), np.int32)
    chunks, parts = np.maximum(1, -(-held // most)), np.maximum(1, -(-read // PART_ROWS))
    block, rows, asked = -1, most + 1, 0
    for k, (n, q) in enumerate(zip(held.tolist(), read.tolist(), strict=True)):
        if rows + n > most or asked + q > PART_ROWS:
            block, rows, asked = block + 1, 0, 0
        first[k] = block
        rows, asked = rows + n, asked + q
        block += int(chunks[k]) - 1
    return first, chunks.astype(np.int32), parts.astype(np.int32)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component from the first on, so that they don't depend on what else is computed."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * vectors[:, j]
    return total


def best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of each query's nearest, of equal ones those of smaller ids, vectors of its own id left out. Ties are settled a slice of queries at a time."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    largest = np.abs(v).sum(axis=1).max(initial=0)
    for s in _blocks(len(q), max(1, (2 << 20) // max(1, len(v)))):
        with np.errstate(over="ignore", invalid="ignore"):
            products = np.nan_to_num(q[s] @ v.T, nan=-np.inf)
        products[q_id[s][:, None] == v_id[None, :]] = -np.inf
        if len(v_id) > nearest:
            last = -np.partition(-products, nearest - 1, axis=1)[:, nearest - 1]
            # by more than the roundings of either way of summing
            last = last - np.minimum(1e-12 * np.abs(q[s]).max(axis=1) * largest, 1e300)
        else:
            last = np.full(len(products), -np.inf)
        row, at = np.nonzero((products >= last[:, None]) & (q_id[s][:, None] != v_id[None, :]))
        score = exact(q[s][row], v[at])
        order = np.lexsort((v_id[at], -score, row))
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[rank < nearest]
        out.append((q_id[s][row[keep]], v_id[at[keep]], score[keep]))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return a, b, c


def _sizes(placed: DataFrame, lists: int) -> np.ndarray:
    out = np.zeros(lists, np.int64)
    for r in placed.select(F.explode("lists").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect():  # a row for each list
        out[r["k"]] = r["n"]
    return out


def _search(queries: DataFrame, held: DataFrame, sizes: np.ndarray, index: Index, nearest: int, least: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each query in the lists that it reads, which hold at least so many rows. held: vectors with their lists, sizes: rows of each list."""
    read = frames.cut(_placed(queries, index, sizes, least))
    first, chunks, parts = deal(sizes, _sizes(read, len(sizes)))
    of = lambda table, k: F.element_at(F.lit(table.tolist()), k + 1)
    hashed = lambda n, *by: F.pmod(F.xxhash64(*by), n.cast("long")).cast("int")
    at = lambda blocks: F.explode(F.array_distinct(blocks)).alias("at")
    in_list = held.select("vec_id", "embedding", at(F.transform("lists", lambda k: F.struct((of(first, k) + hashed(of(chunks, k), "vec_id", "dealt")).alias("block"), of(parts, k).alias("parts")))))
    left = in_list.select("at.block", F.explode(F.sequence(F.lit(0), F.col("at.parts") - 1)).alias("part"), "vec_id", "embedding")
    to_read = read.select("vec_id", "embedding", at(F.flatten(F.transform("lists", lambda k: F.transform(F.sequence(of(first, k), of(first, k) + of(chunks, k) - 1), lambda b: F.struct(b.alias("block"), of(parts, k).alias("parts")))))))
    right = to_read.select("at.block", hashed(F.col("at.parts"), "vec_id").alias("part"), "vec_id", "embedding")
    size = index.size

    def rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors, equal rows once."""
        table = table.combine_chunks()
        ids = table.column("vec_id").to_numpy()
        x = matrix(table.column("embedding").combine_chunks(), size)[1] if len(ids) else np.zeros((0, size))
        if len(np.unique(ids)) < len(ids):
            keep = np.unique(np.concatenate([ids.view(np.uint64)[:, None], np.ascontiguousarray(x).view(np.uint64)], axis=1), axis=0, return_index=True)[1]
            ids, x = ids[keep], x[keep]
        return ids, x

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q_id, v_id, score = best(*rows(a), *rows(b), nearest)
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.float64())})

    found = right.groupBy("block", "part").cogroup(left.groupBy("block", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    # a vector found in several lists has one score, so one rank, before the copies go; ranks are cut before the shuffle
    ranked = found.withColumn("rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score").distinct()


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of queries its nearest rows of vectors (both vec_id, embedding), those of its own vec_id left out."""
    vectors = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for index in build(vectors):
        own, mine = vectors.where(F.col("size") == index.size), asked.where(F.col("size") == index.size)
        held = frames.cut(_placed(own, index))
        sizes = _sizes(held, len(index.graph.centroids))
        # a row is in up to COPIES lists, the query's own among them
        answers = frames.cut(_search(mine, held, sizes, index, nearest, COPIES * (nearest + 1)))
        full = answers.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"))
        short = frames.cut(mine.join(full, "vec_id", "left_anti"))
        if not short.isEmpty():  # lists of equal rows, or few candidates: all lists are read
            answers = answers.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_search(short, held, sizes, index, nearest, 1 << 62))
        found = found.unionByName(answers)
    return found


def report(vectors: DataFrame, every: int = 20, nearest: int = NEAREST) -> DataFrame:
    """The nearest of every row whose vec_id is divisible by every."""
    return search(vectors, vectors.where(F.col("vec_id").cast("long") % every == 0), nearest)
