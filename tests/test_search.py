import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import metrics
from vectide.operators import hnsw, ivf, kmeans, pq, search, topk, transform
from vectide.operators.sampling import Lcg, bounded_sample, split_seed
from vectide.schema import METRICS, Collection, VectorError, checked, metric_of
from vectide.sources.generators import random_collection


def table(spark, rows, kind="string"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"id {kind}, vector array<float>")


def queries(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid int, q array<float>")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_axes(spark):
    c = table(spark, [("a", [0, 0, 1]), ("b", [0, 1, 0]), ("c", [1, 0, 0])])
    assert ids(search.knn(c, [1, 0, 0], 2)) == ["c", "a"]
    assert [r.id for r in search.batch_knn(c, queries(spark, [1, 0, 0], [0, 1, 0]), 1).orderBy("qid").collect()] == ["c", "b"]
    assert search.knn(c, [1, 0, 0], 0).count() == 0
    assert search.knn(c, [1, 0, 0], 99).count() == 3


@pytest.mark.parametrize("metric", METRICS)
def test_all_metrics_and_strategies(spark, metric):
    c = table(spark, [("a", [1, 0]), ("b", [0, 1])])
    assert ids(search.knn(c, [0.9, 0.1], 1, metric)) == ["a"]
    x = np.random.default_rng(5).standard_normal((200, 70)).astype(np.float32)
    c, q = table(spark, enumerate(x), "long"), queries(spark, *x[:7])
    a, b = (search.batch_knn(c, q, 9, metric, strategy=s).orderBy("qid", "rank").collect() for s in ("expr", "arrow"))
    assert [(r.qid, r.rank, r.id) for r in a] == [(r.qid, r.rank, r.id) for r in b]
    assert np.allclose([r.distance for r in a], [r.distance for r in b])


def test_zero_vectors_are_one_away_by_cosine(spark):
    c = table(spark, [("z", [0, 0]), ("a", [1, 0])])
    assert {r.id: r.distance for r in search.knn(c, [1, 0], 2, "cosine").collect()} == {"a": 0.0, "z": 1.0}


def test_filter_before_or_after(spark):
    c = table(spark, [("x", [0, 0]), ("y", [1, 0])]).withColumn("keep", F.col("id") == "y")
    q = queries(spark, [0.1, 0])
    assert [r.id for r in search.batch_knn(c, q, 1, where=F.col("keep")).collect()] == ["y"]
    assert search.batch_knn(c, q, 1, where=F.col("keep"), filter_mode="post").count() == 0


def test_many_query_blocks_give_the_same(spark, monkeypatch):
    c = random_collection(spark, 300, 16)
    q = c.where("id < 40").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    once = search.batch_knn(c, q, 5).orderBy("qid", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BYTES", 2_000)
    assert search.batch_knn(c, q, 5).orderBy("qid", "rank").collect() == once


def test_ranges(spark):
    x = np.random.default_rng(7).standard_normal((500, 16))
    c, q = table(spark, [(10_000 + i, v) for i, v in enumerate(x)], "long"), np.random.default_rng(8).standard_normal(16)
    x32, q32 = x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    d = np.sqrt(((x32 - q32) ** 2).sum(1))
    limit = float(np.quantile(d, 0.1))
    got = {r.id for r in search.range_search(c, queries(spark, q), limit).collect()}
    assert got == {10_000 + i for i in np.flatnonzero(d <= limit)}
    assert search.range_search(c, queries(spark, q), -limit).count() == 0
    assert search.range_mask(c, queries(spark, q), limit).agg(F.sum("mask")).first()[0] == len(got)


def test_rerank_ties_missing_and_wide_ids(spark):
    far = 2**40
    c = table(spark, [(far + 2, [1, 0]), (far + 1, [1, 0]), (3, [0, 1])], "long")
    cand = spark.createDataFrame([(0, far + 2), (0, far + 1), (0, 3), (0, 77)], "qid int, id long")
    got = search.rerank_top_k(cand, c, queries(spark, [1, 0]), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [far + 1, far + 2, 3]
    missing = search.rerank_scores(cand, c, queries(spark, [1, 0])).where("id = 77").first()
    assert math.isinf(missing.score) and not missing.present


def test_reservoir_and_top_k(spark):
    df = spark.createDataFrame([(0, 0, 10, 5.0), (0, 1, 20, 3.0), (0, 2, 30, 3.0), (0, 3, 40, 1.0), (0, 4, 50, float("nan")), (0, 5, 40, 0.5)], "qid int, pos int, id long, score double")
    assert [r.id for r in topk.reservoir(df, 4, pos="pos").orderBy("rank").collect()] == [40, 20, 30, 10]
    assert [r.id for r in topk.reservoir(df, 2, pos="pos").orderBy("rank").collect()] == [40, 20]
    assert topk.seen_stats(df, "id").first()["duplicates"] == 1


def test_candidates_go_out_and_come_back(spark):
    c, q = table(spark, [("a", [0, 0]), ("b", [1, 0])]), queries(spark, [1, 0])
    offered = search.candidates(c, q)
    found = spark.createDataFrame([(0, 1, 0.0), (0, 0, 1.0), (0, 9, 0.1)], "qid int, pos int, distance double")
    assert [r.id for r in search.finalize(found, offered, 5).orderBy("rank").collect()] == ["b", "a"]


def test_errors(spark):
    c = table(spark, [("a", [0, 0])])
    with pytest.raises(VectorError) as e:
        checked(c, 3, "insert")
    assert e.value.kind == "dimension_mismatch" and e.value.recoverable and e.value.info["found"] == 2
    for bad in (lambda: Collection(0), lambda: Collection(2, "hamming"), lambda: Collection(2, "manhattan", "hnsw"), lambda: search.knn(c, [0, 0], 1, "hamming"), lambda: search.knn_graph(c, 1, "dot"), lambda: VectorError("no_such", "x")):
        with pytest.raises((VectorError, ValueError)):
            bad()
    assert metric_of("nonsense") == "euclidean"


# inverted lists, k-means, codes


def test_clusters(spark):
    rows = [("x1", [0, 0]), ("x2", [0.05, -0.02]), ("y1", [1, 0]), ("y2", [0.95, 0.04])]
    c = table(spark, rows)
    model = ivf.train(c, 2)
    lists = ivf.build(c, model)
    assert lists.groupBy("list_id").count().count() == 2
    assert {r.id for r in ivf.search(lists, model, queries(spark, [0.98, 0]), 2, 1).collect()} == {"y1", "y2"}
    assert ivf.search(c, None, queries(spark, [0.98, 0]), 1, 1).first().id == "y1"


def test_all_lists_are_exact_and_recall_grows(spark):
    x = Lcg(777).vectors(400, 32)
    c, q = table(spark, enumerate(x), "long"), queries(spark, *Lcg(888).vectors(30, 32))
    model = spark.createDataFrame(ivf.train(c, 32).collect(), "list_id int, centroid array<double>")
    lists = ivf.build(c, model).cache()
    exact = {(r.qid, r.id) for r in search.batch_knn(c, q, 5).collect()}
    share = [len(exact & {(r.qid, r.id) for r in ivf.search(lists, model, q, 5, n).collect()}) / len(exact) for n in (1, 6, 32)]
    assert share[0] <= share[1] <= share[2] == 1.0 and share[1] >= 0.6


def test_seeding_and_training():
    x = np.concatenate([np.random.default_rng(i).normal(i * 10, 0.1, (50, 4)) for i in range(4)])
    s = kmeans.seed_plus_plus(x, 4, 3)
    assert s.chosen == kmeans.seed_plus_plus(x, 4, 3).chosen and len({i // 50 for i in s.chosen}) == 4
    c, inertia = kmeans.mini_batch(x, 4, 3)
    assert inertia < 20 and len(c) == 4
    assert len(set(kmeans.seed_plus_plus(np.zeros((5, 2)), 5).chosen)) == 5
    with pytest.raises(VectorError):
        kmeans.seed_plus_plus(x, 0)


def test_codes_of_clusterable_data(spark):
    rng = np.random.default_rng(11)
    centers = rng.standard_normal((16, 32))
    x = centers[rng.integers(16, size=600)] + rng.normal(0, 0.05, (600, 32))
    c = table(spark, enumerate(x), "long")
    few, many = (pq.distortion(pq.encode(c, spark.createDataFrame(pq.train(c, 4, ks).collect(), "sub int, code int, centroid array<double>"), 4)).first()[0] for ks in (2, 32))
    assert many < few * 0.2
    with pytest.raises(VectorError):
        pq.train(c, 5, 4)
    with pytest.raises(VectorError):
        pq.train(c, 4, 1000)


def test_residuals_without_centroid_fail(spark):
    c = table(spark, [(0, [1, 2])], "long").withColumn("list_id", F.lit(9))
    with pytest.raises(Exception, match="without a centroid"):
        transform.residuals(c, spark.createDataFrame([(0, [0.0, 0.0])], "list_id int, centroid array<double>")).collect()


# graphs


def test_neighbor_choice():
    x = np.array([[0, 0], [1, 0], [2, 0], [1, 0.1]], float)
    assert hnsw.choose_neighbors(x[0], np.array([1, 2, 3]), x, 2) == [1, 3]
    assert hnsw.prune_neighbors(x[0], 0, np.array([0, 1, 1, 2, 3]), x, 2) == [1, 3]


def test_graph_recall_and_determinism(spark):
    x = Lcg(42).vectors(300, 32)
    c, q = table(spark, enumerate(x), "long"), queries(spark, *Lcg(4242).vectors(20, 32))
    s = hnsw.Settings(12, 100, 64)
    graphs = hnsw.build(c, "euclidean", s).cache()
    assert graphs.collect() == hnsw.build(c, "euclidean", s).collect()
    exact = {(r.qid, r.id) for r in search.batch_knn(c, q, 5).collect()}
    assert len(exact & {(r.qid, r.id) for r in hnsw.search(graphs, q, 5, "euclidean", s).collect()}) / len(exact) >= 0.6
    sharded = hnsw.build(c, "euclidean", s, rows_per_shard=100)
    assert len(exact & {(r.qid, r.id) for r in hnsw.search(sharded, q, 5, "euclidean", s).collect()}) / len(exact) >= 0.6
    degree = hnsw.edges(graphs).groupBy("level", "src").count().agg(F.max("count")).first()[0]
    assert degree <= s.m and hnsw.statistics(graphs).first()["count"] == 300
    top = hnsw.nodes(graphs).where("entry").collect()
    assert hnsw.nodes(graphs).count() == 300 and len(top) == 1 and top[0].level == hnsw.nodes(graphs).agg(F.max("level")).first()[0]


def test_graph_filters(spark):
    x = Lcg(9).vectors(200, 16)
    c, q = table(spark, enumerate(x), "long"), queries(spark, *x[:5])
    graphs, allowed = hnsw.build(c, "cosine"), c.where("id % 2 = 1")
    assert hnsw.search(graphs, q, 5, "cosine", allowed=allowed).where("id % 2 = 0").count() == 0
    assert hnsw.search(graphs, q, 5, "cosine", allowed=allowed).count() == 25
    assert hnsw.search(graphs, q, 5, "cosine", allowed=allowed, filter_mode="post").count() < 25


def test_the_sequence_can_be_jumped_ahead():
    for seed in (0, 777, 2**63):
        steps = Lcg(seed)
        for n in range(70):
            assert Lcg(seed).jump(n).state == steps.state
            steps.next()
    far = Lcg(5).jump(10**18)
    assert far.jump(3).state == Lcg(5).jump(10**18 + 3).state


def test_generator_and_sampling(spark):
    a, b = (random_collection(spark, 50, 8, clusters=3, partitions=p).orderBy("id").collect() for p in (1, 7))
    assert a == b and abs(sum(v * v for v in a[0].vector) - 1) < 1e-5
    c = random_collection(spark, 100, 4)
    assert sorted(r.id for r in bounded_sample(c, 10, 1).collect()) == sorted(r.id for r in bounded_sample(c.repartition(9), 10, 1).collect())
    assert len(set(split_seed(1, 5))) == 5


def test_wide_vectors_use_folds(spark):
    x = np.random.default_rng(1).standard_normal((5, 200)).astype(np.float32)
    got = table(spark, enumerate(x), "long").select(metrics.norm_squared(F.col("vector"), 200).alias("n"), metrics.chebyshev(F.col("vector"), F.col("vector"), 200).alias("c")).collect()
    assert np.allclose([r.n for r in got], (x.astype(float) ** 2).sum(1)) and all(r.c == 0 for r in got)
