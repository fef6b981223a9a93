"""Graphs of many rows: bounded numbers of shards, and the forms that take many nodes or queries at once."""

import numpy as np
import pytest

from vectide.operators import hnsw, search


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(size=(600, 12))


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_dropping_from_many_nodes_is_choosing_for_each(x, metric):
    nodes = np.array([np.random.default_rng(i).permutation(560)[:17] for i in range(40)])
    got = hnsw.drop_one_each(x[560:], nodes, x, metric)
    assert got.tolist() == [hnsw.choose_neighbors(q, n, x, 16, metric) for q, n in zip(x[560:], nodes)]


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
@pytest.mark.parametrize("barred", [0, 150, 550, 600])
def test_queries_in_step_find_what_one_walk_finds(x, metric, barred):
    g = hnsw.build_graph(x, metric, hnsw.Settings(8, 60, 40))
    mask = np.ones(600, bool)
    mask[np.random.default_rng(1).permutation(600)[:barred]] = False
    q = np.random.default_rng(4).normal(size=(150, 12))
    found = {}
    for rows, nodes, d in g.search_all(q, 5, 40, None if mask.all() else mask):
        assert mask[nodes].all()
        for i, n, v in zip(rows.tolist(), nodes.tolist(), d.tolist()):
            found.setdefault(i, []).append((v, n))
    want = {i: f for i, v in enumerate(q) if (f := g.search(v, 5, 40, mask))}
    assert set(found) == set(want)
    assert all(len(f) == len(want[i]) and f == sorted(f) for i, f in found.items())
    assert sum(len({n for _, n in found[i]} & {n for _, n in want[i]}) for i in want) >= 0.97 * sum(map(len, want.values()))


def test_more_rows_make_shards_larger_once_there_are_many(spark, x):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    s = hnsw.Settings(8, 60, 20)
    graphs = hnsw.build(rows, "euclidean", s, 5).cache()
    assert graphs.count() == hnsw.MOST_SHARDS  # not 120, all of which every query would ask
    q = search.as_queries(spark, x[:10])
    found = hnsw.search(graphs, q, 5, "euclidean", s, rows_per_shard=5).collect()
    want = {(r.qid, r.id) for r in search.batch_knn(rows, q, 5).collect()}
    assert len({(r.qid, r.id) for r in found} & want) >= 0.9 * len(want) and len(found) == 50
    assert hnsw.shards_for(11_999, 500, 64) == hnsw.shards_for(700_000, 500, 64) == 24
    assert hnsw.shards_for(2_001, 500, 64) == 5 and hnsw.shards_for(0, 500, 64) == 1
    assert hnsw.shards_for(10**8, 500, 64) == 1526  # and none is larger than a task can hold
    assert hnsw.wider(64, 500, 500) == 64 and hnsw.wider(64, 750, 500) == 96 and hnsw.wider(64, 30_000, 500) == 256


def test_rows_put_back_are_not_hidden_by_their_tombstones():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(2_000, 32)), rng.normal(size=(100, 32))
    x, q = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    back = np.arange(0, 2_000, 10)
    s = hnsw.Settings(8, 60, 60)
    g = hnsw.build_graph(x, "euclidean", s)
    g.grow(x[back])
    g.dead[back] = True
    earlier = hnsw.Earlier(g, np.array(g.levels + [0] * len(back)))
    for i in range(2_000, 2_000 + len(back)):
        g.add(0, earlier.near(i, True))
    row = np.concatenate([np.arange(2_000), back])
    found = {(int(i), int(row[n])) for a, b, _ in g.search_all(q, 10, 150, ~g.dead) for i, n in zip(a, b)}
    want = {(i, int(n)) for i, v in enumerate(q) for n in np.argsort(((x - v) ** 2).sum(1))[:10] if n % 10 == 0}
    assert len(found & want) >= 0.9 * len(want)
