import random

import numpy as np
import pyarrow as pa

from escriba.llm import neardup
from escriba.llm.components import components

from .conftest import frame, words


def near(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Copies, near copies at all distances, chains, a hub of many copies that are far from each other, and texts that share a passage."""
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(25):
        t = words(rng, rng.randint(5, 120), 5000)
        for share in (0, 0, 0.01, 0.03, 0.05, 0.08):
            rows.append((n, near(rng, t, share) if share else t))
            n += 1
    hub = words(rng, 150, 10**6)
    rows += [(n + i, hub if i == 40 else near(rng, hub, 0.045)) for i in range(80)]
    n += 80
    passage = words(rng, 25, 10**6)
    rows += [(n + i, passage + " " + words(rng, rng.randint(5, 60), 10**6)) for i in range(80)]
    n += 80
    chain = words(rng, 100, 10**6)
    for i in range(12):
        rows.append((n + i, chain))
        chain = near(rng, chain, 0.02)
    return rows


def test_groups_are_brute_forces(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (906, "a  B\n")]
    got = sorted(tuple(r) for r in neardup.report(frame(spark, rows)).collect())
    assert got == sorted(neardup.brute_force(rows))


def test_repeated_rows_and_empty(spark, empty, edges, edge_rows):
    assert neardup.report(empty).count() == 0
    got = neardup.report(edges).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in edge_rows)
    assert {r.component_id for r in got if r.doc_id == 903} == {903}


def test_every_text_of_a_doc_id_is_compared(spark):
    """Pairs whose tables all hold a third text, too far from both, so that only the finer collection finds them; one of each pair is one of four texts of its doc_id."""
    rng = random.Random(12)
    rows = []
    for c in range(0, 400, 100):
        base = words(rng, 150, 10**6)
        rows += [(c + i, near(rng, base, 0.045)) for i in range(30)]
        rows += [(c + 50, words(rng, 150, 10**6)) for _ in range(3)] + [(c + 50, base), (c + 60, near(rng, base, 0.01))]
    want = neardup.brute_force(rows)
    assert sum(d % 100 == 60 and d != component for d, _, component, _ in want) == 4
    assert sorted(tuple(r) for r in neardup.report(frame(spark, rows)).collect()) == sorted(want)


def test_keep_first(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words stand here now and then"), (4, None)]
    kept = neardup.keep_first(frame(spark, rows), k=5)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and kept.columns == frame(spark, []).columns


def test_blocks_of_a_cell():
    rng = np.random.default_rng(1)
    common = rng.integers(-(2**62), 2**62, 100)
    sets = [np.sort(np.concatenate([common[: 100 - i], rng.integers(-(2**62), 2**62, i)])) for i in (0, 5, 10, 30, 60)]
    table = pa.table(
        {
            "rep": pa.array(range(5), pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "component": pa.array([0, 1, 1, 3, 4], pa.int64()),
            "block": pa.array([0] * 5, pa.int32()),
            "lo": pa.array([0] * 5, pa.int32()),
            "hi": pa.array([0] * 5, pa.int32()),
            "bits": pa.array([[0] * neardup.FINE.words()] * 5, pa.list_(pa.int64())),
            "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())),
        }
    )
    got = neardup._links_between(table, 80).to_pylist()
    assert got == [{"a": 1, "b": 0}]  # 2 is in the piece of 1 already; 3 and 4 are too far


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def sharing(rng, n):
    """Texts that share most of their words but aren't near-duplicates, and a few that are."""
    passage = words(rng, 60, 10**6)
    rows = [(i, passage + " " + words(rng, 40, 10**6)) for i in range(n)]
    return rows + [(n + i, near(rng, rows[i * 7][1], 0.02)) for i in range(n // 20)]


def test_many_texts_that_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "CELL_BLOCKS", 2)
    dealt = []
    plain = neardup._compared

    def counted(fine):
        out = plain(fine)
        dealt.append([rows.count() for rows in out])
        return out

    monkeypatch.setattr(neardup, "_compared", counted)
    for n in (300, 600):
        rows = sharing(random.Random(n), n)
        assert sorted(tuple(r) for r in neardup.report(frame(spark, rows)).collect()) == sorted(neardup.brute_force(rows))
    # two lists: of cells and of single tables; a cell as a whole would be n^2 / 8 rows
    assert all(len(d) == 2 for d in dealt) and 0 < sum(dealt[1]) < 3 * sum(dealt[0]) and sum(dealt[1]) < 600 * 600 / 8 / 2
