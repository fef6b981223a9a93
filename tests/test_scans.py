"""Scans of lists, and what all searches do with odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import metrics
from vectide.operators import ivf, lists, pq, scan, search, transform
from vectide.operators.sampling import Lcg
from vectide.schema import METRICS, VectorError

ROWS = "id long, vector array<double>"


def asked(spark, *vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "qid int, q array<double>")


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("strategy", ["expr", "arrow", "auto"])
def test_what_is_no_number_is_not_found(spark, metric, strategy):
    rows = [(1, [0.5, 1.0]), (2, [math.nan, 1.0]), (3, [0.5, None]), (4, [-1.0, 0.25]), (5, [math.nan, math.nan])]
    c, q = spark.createDataFrame(rows, ROWS), asked(spark, [1, 1], [0.2, 0.9])
    for k in (1, 2, 3, 9):
        got = search.batch_knn(c, q, k, metric, strategy=strategy).collect()
        assert {r.qid: sum(x.qid == r.qid for x in got) for r in got} == {0: min(k, 2), 1: min(k, 2)}
        assert {r.id for r in got} <= {1, 4}
    assert {r.id for r in search.knn(c, [1.0, 1.0], 9, metric).collect()} == {1, 4}
    wide = -9.0 if metric in ("dot", "cosine") else 9.0
    assert {r.id for r in search.range_search(c, q, wide, metric, strategy=strategy).collect()} == {1, 4}
    assert {(r.id, r.mask) for r in search.range_mask(c, q, wide, metric).collect()} == {(1, 1), (2, 0), (3, 0), (4, 1), (5, 0)}
    if metric in ("euclidean", "cosine"):
        assert {(r.src, r.dst) for r in search.knn_graph(c, 3, metric, strategy).collect()} == {(1, 4), (4, 1)}


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, 2.0, 3.0], []])
@pytest.mark.parametrize("strategy", ["expr", "arrow", "auto"])
def test_another_dimension_is_an_error(spark, strategy, bad):
    c = spark.createDataFrame([(1, [0.5, 1.0]), (2, bad)], ROWS)
    for found in (
        lambda: search.batch_knn(c, asked(spark, [1, 1]), 1, strategy=strategy),
        lambda: search.batch_knn(c, asked(spark, *[[1, 1]] * 400), 1, strategy=strategy),
        lambda: search.knn(c, [1.0, 1.0], 1),
        lambda: search.range_search(c, asked(spark, [1, 1]), 5.0, strategy=strategy),
    ):
        with pytest.raises(Exception, match="dimension"):
            found().collect()


def clustered(spark, n=1500, d=16):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, d)) * 3
    x = centers[rng.integers(12, size=n)] + rng.standard_normal((n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4).cache(), x


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_codes_and_lists_find_neighbours(spark, metric, monkeypatch):
    c, x = clustered(spark)
    q = asked(spark, *x[:25])
    unit = c if metric != "cosine" else c.withColumn("vector", F.expr("transform(vector, x -> x / sqrt(aggregate(vector, 0D, (a, y) -> a + y * y)))"))
    centroids = spark.createDataFrame(ivf.train(unit, 12).collect(), "list_id int, centroid array<double>")
    rest = transform.residuals(ivf.build(unit, centroids), centroids).select("id", "list_id", F.col("residual").alias("vector")).cache()
    books = spark.createDataFrame(pq.train(rest, 4, 64).collect(), "sub int, code int, centroid array<double>")
    codes = pq.encode_in_place(rest, books, 4).select("id", "list_id", "codes").cache()
    exact = {(r.qid, r.id) for r in search.batch_knn(c, q, 10, metric).collect()}
    rows = pq.search(codes, centroids, books, c, q, 10, 12, 4, 8, metric).orderBy("qid", "rank").collect()
    assert len(exact & {(r.qid, r.id) for r in rows}) >= 0.9 * len(exact)
    vectors = {i: v for i, v in enumerate(x)}
    dot = lambda a, b: float(a @ b)
    by_hand = {"euclidean": lambda a, b: dot(a - b, a - b), "dot": dot, "cosine": lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))}[metric]
    assert all(abs(r.score - by_hand(x[r.qid], vectors[r.id])) < 1e-9 for r in rows)
    # many blocks of queries and of lists give the same
    monkeypatch.setattr(search, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(pq, "CENTROID_BYTES", 500)
    assert pq.search(codes, centroids, books, c, q, 10, 12, 4, 8, metric).orderBy("qid", "rank").collect() == rows


def test_residual_tables_are_the_rows_of_the_tables(spark):
    c, x = clustered(spark, 300)
    q, centroids = asked(spark, *x[:3]), spark.createDataFrame([(i, x[i * 7].tolist()) for i in range(5)], "list_id int, centroid array<double>")
    books = pq.sub_vectors(c.where("id < 20"), 4).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    codes = pq.encode_residual(ivf.build(c, centroids), centroids, books, 4)
    arrays = pq.code_arrays(codes).join(ivf.build(c, centroids).select("id", "list_id"), "id")
    probes = ivf.probes_of(centroids, q, 3, "euclidean")
    tables = pq.table_arrays(pq.residual_lookup_tables(q, probes, centroids, books, 4), ("qid", "list_id"))
    want = {(r.qid, r.id): r.distance for r in pq.adc(arrays, tables, on=("list_id",), m=4).collect()}
    array, model = pq.books_of(books), {r.list_id: np.array(r.centroid) for r in centroids.collect()}
    (block,) = scan.blocks(q, 16, lambda part: ivf.probes_of(centroids, part, 3, "euclidean"), 3)
    made = pq.ResidualTables(block.vectors, array, model, "euclidean")
    got = {(r.qid, r.id): r.distance for r in scan.scan(arrays, "codes", block, lambda col: pq.code_matrix(col, 4), made.score, 10_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_blocks_count_their_probes(spark, monkeypatch):
    x = Lcg(5).vectors(64, 8)
    q = asked(spark, *x)
    centroids = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x[:20])], "list_id int, centroid array<double>")
    monkeypatch.setattr(search, "QUERY_BYTES", 8_000)
    sizes = [len(b.qids) for nprobe in (1, 20) for b in scan.blocks(q, 8, lambda part, n=nprobe: ivf.probes_of(centroids, part, n, "euclidean"), nprobe)]
    assert sum(sizes) == 128 and max(sizes) <= 64
    few = sum(1 for _ in scan.blocks(q, 8, lambda part: ivf.probes_of(centroids, part, 1, "euclidean"), 1))
    assert len(sizes) - few > few


@pytest.mark.parametrize("kind,metric", [("flat", "euclidean"), ("flat", "dot"), ("flat", "cosine"), ("pq8", "euclidean"), ("pq4", "dot")])
def test_stored_lists_are_searched(spark, tmp_path, kind, metric):
    c, x = clustered(spark, 400, 6)
    c = c.withColumn("vector", F.col("vector").cast("array<float>"))
    q, centroids = asked(spark, *x[:9]), spark.createDataFrame([(i, x[i * 11].tolist()) for i in range(6)], "list_id int, centroid array<double>")
    books = None if kind == "flat" else pq.sub_vectors(c.where("id < 16"), 3).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    placed = ivf.build(c, centroids).select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector")
    rows = placed if kind == "flat" else pq.encode_in_place(placed, books, 3)
    path = str(tmp_path / "store")
    lists.ingest(lists.empty(spark), rows, kind, "vector" if kind == "flat" else "codes").write.partitionBy("list_id").parquet(path)
    store = spark.read.parquet(path)
    names = spark.range(400).select(F.col("id").alias("internal_id"), F.format_string("n%d", "id").alias("external_id")).where("internal_id <> 3")
    got = lists.search(store, kind, centroids, q, 5, 2, metric, books, names, F.col("id") != "n5").collect()
    # by hand
    known = {r.external_id: r for r in rows.collect()}
    shown = {i: np.array(r.vector, float) for i, r in known.items()}
    if books is not None:
        book = pq.books_of(books)
        shown = {i: np.concatenate([book[j, code] for j, code in enumerate(r.codes)]) for i, r in known.items()}
    probes = {(r.qid, r.list_id) for r in ivf.probes_of(centroids, q, 2, metric).collect()}
    up = metrics.ascending(metric)
    for qid in range(9):
        s = lambda v: float(search.raw_scores(x[qid : qid + 1], v[None], metric)[0, 0])  # noqa: B023, E731
        best = sorted((s(v) if up else -s(v), i) for i, v in shown.items() if (qid, known[i].list_id) in probes)[:5]
        want = [(f"n{i}", d if up else -d) for d, i in best if i not in (3, 5)]
        mine = sorted((r.rank, r.id, r.score) for r in got if r.qid == qid)
        assert [i for _, i, _ in mine] == [i for i, _ in want] and np.allclose([v for *_, v in mine], [v for _, v in want])


def test_list_searches_check_their_input(spark):
    store = lists.empty(spark)
    centroids = spark.createDataFrame([(0, [0.0, 0.0])], "list_id int, centroid array<double>")
    q = asked(spark, [1, 1])
    for kind, metric, books in (("pq9", "euclidean", None), ("flat", "manhattan", None), ("pq8", "cosine", centroids), ("pq8", "euclidean", None)):
        with pytest.raises(VectorError):
            lists.search(store, kind, centroids, q, 1, 1, metric, books)
    assert lists.search(store, "flat", centroids, q, 3, 1).collect() == []
    torn = spark.createDataFrame([(0, 0, 7, bytearray(b"abc"))], lists.SCHEMA)
    with pytest.raises(Exception, match="another length"):
        lists.search(torn, "flat", centroids, q, 3, 1).collect()


def test_arrays_are_queries(spark):
    for x in ([1, 2], np.array([1, 2], np.float16), np.array([[1, 2]], np.int8), ((1.0, 2.0),)):
        assert [tuple(r) for r in search.as_queries(spark, x).collect()] == [(0, [1.0, 2.0])]
    assert [r.qid for r in search.as_queries(spark, np.eye(2), ["a", "b"]).collect()] == ["a", "b"]
    for bad in ((np.zeros((0, 2)),), (np.eye(2), [1])):
        with pytest.raises(VectorError):
            search.as_queries(spark, *bad)


def test_padded_reranking(spark):
    c = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 4.0])], ROWS)
    offered = spark.createDataFrame([(0, 1), (0, 2), (0, 9), (1, 9)], "qid int, id long")
    q = asked(spark, [0, 0], [1, 1])
    got = sorted(map(tuple, search.rerank_top_k(offered, c, q, 3, pad=True).collect()), key=lambda r: r[:2])
    inf = float("inf")
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 25.0), (0, 3, None, inf), (1, 1, None, inf), (1, 2, None, inf), (1, 3, None, inf)]
    assert search.rerank_top_k(offered, c, q, 2, "dot", pad=True).where("score = double('-infinity')").count() == 2


def test_candidates_of_probes_and_norms_beside_vectors(spark):
    c, x = clustered(spark, 200, 4)
    q, centroids = asked(spark, *x[:3]), spark.createDataFrame([(i, x[i * 9].tolist()) for i in range(5)], "list_id int, centroid array<double>")
    placed, probes = ivf.build(c, centroids), ivf.probes_of(centroids, q, 2, "euclidean")
    got = search.candidates(placed, q, probes).collect()
    lists_of = {r.id: r.list_id for r in placed.collect()}
    want = {(p.qid, i) for p in probes.collect() for i, at in lists_of.items() if at == p.list_id}
    assert {(r.qid, r.id) for r in got} == want and len(got) == len(want)
    for qid in range(3):
        mine = sorted((r.pos, r.id) for r in got if r.qid == qid)
        assert [p for p, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
    key = lambda df: sorted((r.qid, r.id, r.score) for r in df.collect())
    assert key(transform.cosine_with_norms(transform.with_norms(c), None, q)) == key(transform.cosine_with_norms(c, transform.norms(c), q))
    with pytest.raises(VectorError):
        transform.cosine_with_norms(c, None, q)


def test_stores_record_their_format(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 1, [1, 2, 3])], "list_id int, external_id long, seq long, codes array<int>")
    lists.save(lists.ingest(lists.empty(spark), rows, "pq4"), str(tmp_path / "s"), "pq4", 3)
    store, kind, m = lists.load(spark, str(tmp_path / "s"))
    assert (kind, m) == ("pq4", 3) and lists.read_list(store, 0, kind, m).first().content == [1, 2, 3]
    with pytest.raises(VectorError):
        lists.load(spark, str(tmp_path / "s"), "pq8")
    with pytest.raises(VectorError):
        lists.save(store, str(tmp_path / "t"), "pq9", 3)


def test_searches_count_what_they_do(spark):
    from vectide.operators import hnsw
    from vectide.operators.telemetry import COUNTERS, Telemetry

    c, x = clustered(spark, 300, 8)
    q, told = asked(spark, *x[:4]), Telemetry(spark)
    graphs = hnsw.build(c, "euclidean", hnsw.Settings(8, 40, 20), 100).cache()
    found = hnsw.search(graphs, q, 5, "euclidean", hnsw.Settings(8, 40, 20), telemetry=told).collect()
    seen = told.values()
    assert len(found) == 20 and seen["found"] == graphs.count() * 20 and 0 < seen["nodes_visited"] < 4 * 300
    told = Telemetry(spark)
    centroids = spark.createDataFrame([(i, x[i * 9].tolist()) for i in range(5)], "list_id int, centroid array<double>")
    placed = ivf.build(c, centroids)
    ivf.search(placed, centroids, q, 5, 2, telemetry=told).collect()
    want = ivf.probes_of(centroids, q, 2, "euclidean").join(placed, "list_id").count()
    assert told.values()["rows_scored"] == want and told.values()["lists_probed"] >= 8
    told = Telemetry(spark)
    rows = search.range_search(c, q, 2.0, strategy="arrow", telemetry=told).collect()
    seen = told.row().first()
    assert seen.found == len(rows) and seen.range_scored + seen.range_skipped == 1200 and seen.range_skipped > 0 and seen.nanos > 0
    assert set(COUNTERS) < set(seen.asDict())
