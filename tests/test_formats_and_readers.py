"""16-bit floats, norm hints, vector readers, typed inputs, and indexes of imported records."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import codecs
from vectide.operators import hnsw, ivf, lists, readers, search, transform
from vectide.schema import Collection, VectorError
from vectide.sources import collection as store
from vectide.sources.collection import DurableCollection
from vectide.sources.graphs import DurableGraph
from vectide.sources.listed import ListIndex
from vectide.sources.restore import restore

ROWS = "id long, vector array<double>"


def asked(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid int, q array<double>")


def some(spark, n=60, d=6, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(3), x


def test_half_bits_are_those_of_the_hardware(spark):
    rng = np.random.default_rng(0)
    edges = [0.0, 65504.0, 65519.9, 65520.0, 1e9, 2.0**-14, 2.0**-24, 2.0**-25, 2.0**-26, 1.0, 2.0, 4.0, 8.0, 2048.0, 2049.0, 2051.0, 1 + 2.0**-11, 1 + 3 * 2.0**-11, 2.0**-14 - 2.0**-25]
    edges += [np.nextafter(2.0**e, s * 9e9) for e in range(-14, 16) for s in (-1, 1)] + [2.0**e for e in range(-24, 16)]
    x = np.concatenate([edges, np.exp(rng.uniform(-20, 12, 3000))])
    x = np.concatenate([x, -x[x > 0]])
    want = np.clip(x, -65504, 65504).astype(np.float16)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "x": x}))
    got = df.select("i", codecs.half_bits(F.col("x")).alias("b")).withColumn("back", codecs.from_half_bits(F.col("b"))).toPandas().sort_values("i")
    keep = ~((want == 0) & np.signbit(want))  # a negative number that becomes zero keeps its sign
    assert (got.b.to_numpy()[keep] == want.view(np.int16)[keep]).all()
    assert (got.back.to_numpy() == want.astype(float)).all()
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(codecs.half_bits(F.col("x")).alias("b"))
    assert [r.b for r in odd.collect()] == [0x7E00, 0x7BFF, None]
    back = spark.createDataFrame([(0x7C00,), (0x7C00 - 0x8000,), (0x7E00,)], "b int").select(codecs.from_half_bits(F.col("b").cast("smallint")).alias("x"))
    got = [r.x for r in back.collect()]
    assert got[:2] == [float("inf"), float("-inf")] and np.isnan(got[2])


def test_sixteen_bit_lists_keep_nulls(spark):
    df = spark.createDataFrame([([0.1, None, -1e9],), (None,), ([],), ([float("nan"), 3.0],)], "v array<double>").coalesce(1)
    got = [r[0] for r in df.select(codecs.through_float16(F.col("v"))).collect()]
    assert got[0] == [float(np.float16(0.1)), None, -65504.0] and got[1:3] == [None, []] and np.isnan(got[3][0])
    got = [r[0] for r in df.select(codecs.through_bfloat16(F.col("v"))).collect()]
    assert got[0][:2] == [0.10009765625, None] and got[1:3] == [None, []] and np.isnan(got[3][0]) and got[3][1] == 3.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-70000, 70000, width=32), min_size=1, max_size=40))
def test_half_payloads_round_trip(spark, x):
    df = spark.createDataFrame([(x,)], "v array<float>")
    packed = df.select(lists.pack("half", F.col("v")).alias("p"))
    assert packed.select(F.octet_length("p")).first()[0] == 2 * len(x)
    want = np.clip(np.float32(x), -65504, 65504).astype(np.float16).astype(float).tolist()
    assert packed.select(lists.unpack("half", F.col("p"))).first()[0] == want


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_half_lists_find_what_flat_ones_find(spark, metric):
    c, x = some(spark, 300, 8)
    q, centroids = asked(spark, *x[:5]), spark.createDataFrame([(i, x[i * 30].tolist()) for i in range(6)], "list_id int, centroid array<double>")
    rows = ivf.build(c, centroids).select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector")
    found = {}
    for kind in lists.VECTORS:
        kept = lists.ingest(lists.empty(spark), rows, kind, "vector")
        found[kind] = {(r.qid, r.id) for r in lists.search(kept, kind, centroids, q, 10, 6, metric).collect()}
    assert len(found["half"]) == 50 and len(found["half"] & found["flat"]) >= 47


@pytest.mark.parametrize("strategy", ["expr", "arrow"])
def test_norm_hints(spark, strategy):
    c, x = some(spark)
    q = asked(spark, *x[:4])
    key = lambda df: sorted((r.qid, r.rank, r.id, r.distance) for r in df.collect())
    want = key(search.batch_knn(c, q, 7, "cosine", strategy=strategy))
    known = c.join(transform.norms(c), "id")
    odd = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("norm_sq"))
    assert key(search.batch_knn(known, q, 7, "cosine", strategy=strategy, norms="norm_sq")) == want
    assert key(search.batch_knn(known.withColumn("h", odd), q, 7, "cosine", strategy=strategy, norms="h")) == want
    # a hint is taken on trust: norms of 1 make it the inner product over the query's norm
    unit = search.batch_knn(c, q, 60, "cosine", strategy=strategy, norms=search.NORMALIZED).collect()
    for r in unit:
        assert abs(r.distance - (1 - np.clip(x[r.id] @ x[r.qid] / np.linalg.norm(x[r.qid]), -1, 1))) < 1e-9
    for metric in ("euclidean", "dot", "manhattan"):
        assert key(search.batch_knn(known, q, 5, metric, strategy=strategy, norms="norm_sq")) == key(search.batch_knn(c, q, 5, metric, strategy=strategy))


def test_norm_hint_of_one_query(spark):
    c, x = some(spark)
    known = c.join(transform.norms(c), "id")
    for query in (x[3], x[3].tolist(), tuple(x[3])):
        assert search.knn(known, query, 5, "cosine", norms="norm_sq").collect() == search.knn(c, query, 5, "cosine").collect()


def test_half_norms_stay_close_and_within_bounds(spark):
    c, x = some(spark)
    q = asked(spark, *x[:4])
    exact = {(r.qid, r.id): r.score for r in transform.cosine_with_norms(transform.with_norms(c), None, q).collect()}
    kept = transform.with_norms(c, half=True)
    assert kept.schema["inv_norm_half"].dataType.simpleString() == "smallint"
    half = {(r.qid, r.id): r.score for r in transform.cosine_with_norms(kept, None, q, clamp=True).collect()}
    assert set(half) == set(exact) and all(abs(half[p] - exact[p]) < 1e-3 and abs(half[p]) <= 1 for p in exact)


def readers_of(spark, c, x, tmp_path):
    centroids = spark.createDataFrame([(i, x[i * 9].tolist()) for i in range(5)], "list_id int, centroid array<double>")
    placed = ivf.build(c, centroids)
    rows = placed.select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector")
    lists.save(lists.ingest(lists.empty(spark), rows, "flat", "vector"), str(tmp_path / "lists"), "flat", x.shape[1])
    kept, kind, _ = lists.load(spark, str(tmp_path / "lists"))

    def ask(ids):
        known = [i < len(x) for i in ids]
        return x[[i if k else 0 for i, k in zip(ids, known)]], known

    return {"table": readers.TableReader(c), "lists": readers.ListReader(kept, kind), "callback": readers.CallbackReader(ask, x.shape[1])}, placed


def test_readers_agree(spark, tmp_path):
    c, x = some(spark)
    x = x.astype(np.float32).astype(float)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS)
    every, placed = readers_of(spark, c, x, tmp_path)
    q = asked(spark, *x[:3])
    offered = spark.createDataFrame([(i, j) for i in range(3) for j in (5, 9, 31, 44, 58, 77)] + [(0, 9)], "qid int, id long")
    key = lambda df: sorted((r.qid, r.id, round(r.score, 9), r.present) for r in df.collect())
    want = key(search.rerank_scores(offered, c, q))
    assert sum(not r[3] for r in want) == 3
    named = offered.join(placed.select("id", "list_id"), "id", "left")
    for reader in every.values():
        assert key(search.rerank_scores(offered, reader, q)) == want
        assert key(search.rerank_scores(named, reader, q)) == want
        assert search.rerank_top_k(offered, reader, q, 2, "dot").collect() == search.rerank_top_k(offered, c, q, 2, "dot").collect()
        assert search.rerank_top_k(offered.where("id = 77"), reader, q, 2, pad=True).count() == 6
        assert not every["table"].fetch(offered.limit(0)).count() and not reader.fetch(offered.limit(0)).count()
    assert prunes(search.rerank_scores(named, every["lists"], q))
    assert not prunes(search.rerank_scores(offered, every["lists"], q))


def prunes(df):
    """Whether the files that a scan reads follow from a broadcast."""
    return "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def test_searches_read_only_the_files_of_probed_lists(spark, tmp_path):
    c, x = some(spark)
    centroids = spark.createDataFrame([(i, x[i * 9].tolist()) for i in range(5)], "list_id int, centroid array<double>")
    rows = ivf.build(c, centroids).select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector")
    lists.save(lists.ingest(lists.empty(spark), rows, "flat", "vector"), str(tmp_path / "s"), "flat", x.shape[1])
    kept, kind, _ = lists.load(spark, str(tmp_path / "s"))
    found = lists.search(kept, kind, centroids, asked(spark, x[0]), 60, 2)
    assert prunes(found)
    probed = {r.list_id for r in ivf.probes_of(centroids, asked(spark, x[0]), 2, "euclidean").collect()}
    assert {r.id for r in found.collect()} == {r.external_id for r in kept.collect() if r.list_id in probed}


def test_readers_refuse(spark):
    with pytest.raises(VectorError):
        readers.ListReader(lists.empty(spark), "pq8")
    bad = readers.CallbackReader(lambda ids: (np.zeros((len(ids), 3)), [True] * len(ids)), 2)
    with pytest.raises(Exception, match="another shape"):
        bad.fetch(spark.createDataFrame([(1,)], "id long")).collect()


def test_typed_inputs(spark, tmp_path):
    items = {
        "tuples": [("a", np.array([1, 2], np.float16), {"t": "x"}), ("b", (3, 4))],
        "mapping": {"a": [1.0, 2.0], "b": np.array([3, 4], np.int8)},
        "pandas": pd.DataFrame({"id": ["a", "b"], "vector": [np.array([1.0, 2.0]), [3.0, 4.0]], "metadata": [{"t": "x"}, None]}),
        "arrow": pa.table({"id": ["a", "b"], "vector": [[1.0, 2.0], [3.0, 4.0]]}),
        "spark": spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, vector array<double>"),
    }
    for name, given_ in items.items():
        c = DurableCollection.create(spark, str(tmp_path / name), Collection(2))
        c.upsert(given_)
        got = {r.id: (r.vector, r.metadata) for r in c.records().collect()}
        assert {i: v for i, (v, _) in got.items()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}, name
        assert got["a"][1] == ({"t": "x"} if name in ("tuples", "pandas") else None) and got["b"][1] is None
    assert c.update("a", np.array([5, 6], np.int32)) and {r.id: r.vector for r in c.records().collect()}["a"] == [5.0, 6.0]
    with pytest.raises(VectorError, match="dimension"):
        c.upsert({"z": [1.0]})
    assert [r.id for r in c.search(np.array([5, 6]), 1).collect()] == ["a"]
    assert [r.id for r in c.search([[5, 6], [3, 4]], 1).orderBy("qid").collect()] == ["a", "b"]
    with pytest.raises(VectorError, match="dimension"):
        c.search([1.0], 1)


def test_statistics_tell_fragmentation(spark, tmp_path):
    c = DurableCollection.create(spark, str(tmp_path / "c"), Collection(2))
    assert c.statistics()["fragmentation"] == 0
    c.upsert({str(i): [i, i] for i in range(8)})
    c.remove(["0", "1"])
    seen = c.statistics()
    assert seen["count"] == 6 and seen["vector_bytes"] == 48 and seen["fragmentation"] == 0.25 and seen["log_rows"] == 10
    c.compact()
    assert c.statistics()["fragmentation"] == 0 and c.statistics()["log_rows"] == 0


def test_restored_records_have_their_index(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((80, 4))
    rows = spark.createDataFrame([(str(i), v.astype(np.float32).tolist(), {"n": str(i)}) for i, v in enumerate(x)], store.RECORD)
    for kind, settings_, made in (("ivf", {"nlist": 4}, ListIndex), ("hnsw", {"m": 6, "ef_search": 80}, DurableGraph), ("flat", {}, type(None))):
        path = str(tmp_path / f"{kind}.json")
        store.export_json(rows, Collection(4, "euclidean", kind, settings_), path)
        c, index = restore(spark, path, str(tmp_path / kind), kind)
        assert isinstance(index, made) and c.config.settings == settings_ and c.count() == 80
        want = {r.id for r in c.search(x[7], 5).collect()}
        if kind == "ivf":
            assert index.meta["nlist"] == 4 and {r.id for r in index.search(search.as_queries(spark, x[7]), 5, 4).collect()} == want
        if kind == "hnsw":
            assert index.settings == hnsw.Settings(m=6, ef_search=80) and {r.id for r in index.search(search.as_queries(spark, x[7]), 5).collect()} == want
    assert restore(spark, str(tmp_path / "flat.json"), str(tmp_path / "again"), "flat_optimized")[1] is None
    with pytest.raises(VectorError, match="another kind"):
        restore(spark, str(tmp_path / "ivf.json"), str(tmp_path / "no"), "flat")
