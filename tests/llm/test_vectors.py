"""Nearest neighbours and clusters against plain Python and SQL, and their edges."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from escriba.llm import annulus, posting_lists

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, size int, score double, block int, lists string, query_id long"


def vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, 99, 0.5, 1, "x", 3) for i, v in rows], schema)


def unit(rng, n=64):
    v = [rng.gauss(0, 1) for _ in range(n)]
    norm = math.sqrt(sum(x * x for x in v))
    return [float(np.float32(x / norm)) for x in v]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_nearest(rows, every=20, nearest=20):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    asked = {}
    for i, v in rows:
        if i % every == 0:
            asked.setdefault(i, v)
    out = {}
    for q, v in asked.items():
        scored = set()
        for i, w in rows:
            if i != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.add((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:nearest]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_few_vectors_are_all_found(spark):
    """Few enough for one list: the answer is exact, with repeats, ties, sizes and unusable rows."""
    rng = random.Random(2)
    one = unit(rng)
    rows = [(i, unit(rng)) for i in range(12)] + [(20, one), (21, one), (22, one), (22, one), (23, [x / 2 for x in one]), (40, [-x for x in one])]
    rows += [(None, one), (60, None), (61, []), (80, [0.0] * 64), (100, [None] + one[1:]), (120, [float("nan")] + one[1:]), (140, [float("inf")] + one[1:]), (160, [1.0, 2.0]), (161, [3.0, 1.0]), (180, [5.0])]
    assert found(posting_lists.report(vectors(spark, rows))) == {q: w for q, w in plain_nearest(rows).items() if w}


def test_a_third_of_equal_vectors(spark, monkeypatch):
    """One vector at a third of all rows is dealt to many blocks and parts; its ties go to the smaller ids."""
    monkeypatch.setattr(posting_lists, "BLOCK_ROWS", 40)
    monkeypatch.setattr(posting_lists, "PART_ROWS", 5)
    rng = random.Random(3)
    one = unit(rng)
    rows = [(i, one if i % 3 == 0 else unit(rng)) for i in range(900)]
    got, want = found(posting_lists.report(vectors(spark, rows))), plain_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        if q % 3 == 0:
            assert got[q] == want[q]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_norms_of_all_sizes(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(x * 10.0 ** (i % 7 - 3))) for x in unit(rng)]) for i in range(600)]
    got, want = found(posting_lists.report(vectors(spark, rows))), plain_nearest(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    scores = {q: dict(w) for q, w in plain_nearest(rows, nearest=10**6).items()}
    assert all(s == scores[q][i] for q in got for i, s in got[q])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_recall_on_real_vectors(spark):
    df = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got, want = found(posting_lists.report(df)), plain_nearest(rows)
    assert all(len(w) == 20 for w in got.values()) and set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_lists_are_balanced_and_the_graph_finds_them():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (3000, 16)) + rng.normal(0, 1, 16), rng.normal(0, 1, (1000, 16))])
    centres = posting_lists.balanced(x, 40)
    sizes = np.bincount(posting_lists._distances(x, centres).argmin(axis=1))
    assert 30 <= len(centres) <= 120 and sizes.max() <= 4 * len(x) / 40
    graph = posting_lists.Graph(centres)
    assert (graph.search(x, 1.1).argmin(axis=1) == posting_lists._distances(x, centres).argmin(axis=1)).mean() > 0.98


def test_blocks_hold_bounded_numbers():
    held, read = np.array([100_000, 5, 7, 0, 9_000]), np.array([50_000, 3, 40_000, 0, 1])
    first, chunks, parts = posting_lists.deal(held, read)
    most = min(posting_lists.BLOCK_ROWS, math.ceil(held.sum() / posting_lists.BLOCKS))
    rows, owners = {}, {}
    for k in range(5):
        for b in range(first[k], first[k] + chunks[k]):
            rows[b] = rows.get(b, 0) + math.ceil(held[k] / chunks[k])
            owners.setdefault(b, []).append(k)
    assert max(rows.values()) <= most and sorted(rows) == list(range(len(rows)))
    assert all(len(ks) == 1 or all(chunks[k] == parts[k] == 1 for k in ks) for ks in owners.values())


def plain_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((squared(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        for j in set(to):
            own = [v for (_, v), t in zip(kept, to) if t == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in last if j == c) for c in range(len(centres))]
    most = 2**63 - 1
    return sorted(((i, j, min(d, most), min(inertia[j], most), min(sum(inertia), most), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def clusters(df):
    return sorted((tuple(r) for r in annulus.report(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_of_mixed_rows(spark):
    rng = random.Random(6)
    one = unit(rng)
    rows = [(i, unit(rng)) for i in range(150)] + [(i, one) for i in range(150, 250)] + [(250 + i, [float(np.float32(x * 1000)) for x in unit(rng)]) for i in range(40)] + [(7, one), (7, one), (None, one), (None, [0.0] * 64), (300, [0.25] * 64), (301, [-0.25] * 64)]
    rows += [(400, None), (401, []), (402, one[:63]), (403, one + [0.0]), (404, [None] + one[1:]), (405, [float("nan")] + one[1:]), (406, [float("-inf")] + one[1:])]
    assert clusters(vectors(spark, rows)) == plain_clusters(rows)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float((i >> j) & 1) for j in range(64)]) for i in range(40)]
    assert clusters(vectors(spark, grid)) == plain_clusters(grid)
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    assert clusters(vectors(spark, few)) == plain_clusters(few)


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.choice([-1, 1]) * (2.0**22 + rng.randrange(2**21)))) for _ in range(64)]) for i in range(40)]
    assert clusters(vectors(spark, rows)) == plain_clusters(rows)
    huge = [(i, [1e38 if i % 2 else -1e38] * 64) for i in range(20)]
    got = clusters(vectors(spark, huge))
    assert len(got) == 20 and all(0 <= r[2] <= 2**63 - 1 for r in got)


def test_annulus_misses_no_nearest():
    rng = np.random.default_rng(5)
    for k in (1, 2, 17, 300):
        centres = rng.integers(-30, 30, (k, 6))
        centres[k // 2 :] = centres[: k - k // 2]  # ties
        x = rng.integers(-40, 40, (500, 6))
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        best, squared = annulus.Annulus(centres).nearest(x)
        assert (best == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()


@pytest.mark.parametrize("report", [posting_lists.report, annulus.report])
def test_empty_tables(spark, report):
    assert report(vectors(spark, [])).collect() == []
    assert report(vectors(spark, [(20, None), (None, None)])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_clusters_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.sql(annulus.ORACLE_SQL).fetchall(), key=str)
    assert len(want) == 500 and clusters(spark.read.parquet(f"{SF}/embeddings.parquet")) == want
