"""Neighbours by cells and rings against every pair."""

import numpy as np
import pytest

from plumbline.operators import blocks, neighbors, similarity


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v], "x", "y") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "sample_id long, embedding array<double>, cell string, rk string")


def every_pair(queries, base, k, exclude_self=True):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-300)
    b_ids = np.array([i for i, _ in base])
    b = np.array([unit(v) for _, v in base])
    found = set()
    for i, v in queries:
        sims = np.round(b @ unit(v), 4)
        order = [j for j in np.lexsort((b_ids, -sims)) if not (exclude_self and b_ids[j] == i)][:k]
        found |= {(i, int(b_ids[j]), float(sims[j]), r + 1) for r, j in enumerate(order)}
    return found


def rows(df):
    return {(r.sample_id, r.neighbor_id, r.sim, r.rk) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = [*(centres[rng.integers(0, 12, 500)] + 0.08 * rng.normal(size=(500, 16)))]
    return v + [centres[0]] * 250 + [np.zeros(16), np.zeros(16), -centres[0], 2 * centres[0]]  # a third is one vector


def test_equal_to_every_pair_and_most_blocks_are_left_out(spark, clustered):
    base = table(spark, clustered)
    index = neighbors.build_cells(base, 6, block_rows=16, max_pivots=24)
    got, visits = neighbors.search_cells(index, base, 5)
    pairs = list(enumerate(clustered))
    assert rows(got) == every_pair(pairs, pairs, 5)
    blocks, asked = index.blocks.count(), visits.filter("pass = 1").select("q_cell", "q_block").distinct().count()
    few = visits.count()
    assert visits.distinct().count() == few
    assert few < 0.6 * blocks * asked, (few, blocks, asked)
    assert index.blocks.count() < 60  # the copies beyond the sixth of the one vector aren't there


def test_without_clusters_too(spark):
    rng = np.random.default_rng(5)
    v = list(rng.normal(size=(300, 24)))
    base, asked = list(enumerate(v)), [(1000 + i, x) for i, x in enumerate(rng.normal(size=(40, 24)))] + [(7, v[7])]
    got = neighbors.nearest(table(spark, [x for _, x in asked], [i for i, _ in asked]), table(spark, v), 4, block_rows=32)
    assert rows(got) == every_pair(asked, base, 4)
    got = neighbors.nearest(table(spark, [x for _, x in asked], [i for i, _ in asked]), table(spark, v), 4, exclude_self=False, block_rows=32)
    assert rows(got) == every_pair(asked, base, 4, exclude_self=False)


def test_odd_rows(spark):
    some = [[1.0, 0.0], None, [], [0.0, 1.0], [float("nan"), 1.0], [1.0, 1.0]]
    assert {r[:2] for r in rows(neighbors.nearest(table(spark, some), table(spark, some), 9))} == {(0, 5), (0, 3), (3, 5), (3, 0), (5, 0), (5, 3)}
    none = table(spark, some).limit(0)
    assert neighbors.nearest(none, none, 3).count() == 0
    assert neighbors.nearest(none, table(spark, some), 3).count() == 0
    assert neighbors.nearest(table(spark, some), none, 3).count() == 0
    with pytest.raises(ValueError):
        neighbors.search_cells(neighbors.build_cells(none, 2), none, 2)


def test_blocks_move_no_more_than_the_rows_grow():
    moved = lambda n, m, answer=2.25: (lambda s: s[0] * m + s[1] * n * (1 + answer))(blocks.grid(n, m, 65536, answer))
    assert moved(600_000, 600_000) <= 1.5 * 6 * moved(100_000, 100_000)
    assert moved(100_000, 100_000) <= 1.5 * 10 * moved(10_000, 10_000)
    for n, m in ((0, 0), (1, 1), (3, 10**6), (10**6, 3), (10**7, 10**7)):
        q, b = blocks.grid(n, m, 65536)
        assert q * 65536 >= n and b * 65536 >= m and 1 <= q <= max(1, n) and 1 <= b <= max(1, m)


@pytest.mark.parametrize("cosine", [True, False])
def test_blocked_join_equals_every_pair(spark, cosine):
    """Copies, equal similarities, zeros, long and short vectors, odd rows, and both kinds of numbers."""
    rng = np.random.default_rng(9)
    v = [x * s for x, s in zip(rng.normal(size=(700, 8)), rng.choice([1e-3, 1.0, 50.0], 700))] + [np.ones(8)] * 300 + [np.zeros(8)] * 3 + [*rng.integers(-1, 2, (200, 8)).astype(float)]
    ids = [int(i) for i in rng.permutation(len(v))]
    odd = [None, [], [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    for kind in ("float", "double"):
        kept = [np.float32(x).astype(float) if kind == "float" else x for x in v]
        rows = [(i, x.tolist()) for i, x in zip(ids, kept)] + [(10_000 + i, x) for i, x in enumerate(odd)]
        df = spark.createDataFrame(rows, f"sample_id long, embedding array<{kind}>")
        m = np.array(kept)[np.argsort(ids)]
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if cosine else m
        sims = np.round(np.einsum("ik,jk->ij", u, u), 4)
        np.fill_diagonal(sims, -np.inf)
        got = {(r.sample_id, r.rk): (r.neighbor_id, r.sim) for r in similarity.knn_join(df, df, 5, block_rows=300, cosine=cosine).collect()}
        assert len(got) == 5 * len(v)
        for i in range(len(v)):
            want = np.lexsort((np.arange(len(v)), -sims[i]))[:5]
            assert [got[i, r + 1][0] for r in range(5)] == [int(j) for j in want] or np.allclose([got[i, r + 1][1] for r in range(5)], sims[i, want], atol=1.01e-4) and not np.allclose(np.mod(sims[i, want] * 1e4, 1), 0.0), i


def test_blocked_join_of_few_rows(spark):
    some, none = table(spark, [[1.0, 0.0], [0.0, 1.0]]), table(spark, [[1.0, 0.0]]).limit(0)
    assert similarity.knn_join(none, some, 3).count() == similarity.knn_join(some, none, 3).count() == similarity.knn_join(none, none, 3).count() == 0
    assert rows(similarity.knn_join(some, some, 3)) == {(0, 1, 0.0, 1), (1, 0, 0.0, 1)}
    with pytest.raises(Exception, match="differ in length"):
        similarity.knn_join(table(spark, [[1.0, 0.0], [1.0]]), some, 1).count()


def test_neighbours_are_searched_for_once(spark, sf_dir, monkeypatch):
    """Ranks, clusters, details and evidence under planted labels read one search."""
    from plumbline.functions import shared_storage
    from plumbline.plans.registry import QUERIES

    calls, search = [], similarity.knn_join
    monkeypatch.setattr(similarity, "knn_join", lambda *a, **b: calls.append(1) or search(*a, **b))
    monkeypatch.setattr(shared_storage, "_WRITTEN", {})
    for name in ("density_percentile", "case_detail", "average_precision"):
        QUERIES[name](spark, sf_dir).count()
    assert len(calls) == 1
