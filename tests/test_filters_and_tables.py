from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import codecs
from vectide.functions.filters import MetadataFilter, id_mask, id_pass
from vectide.operators import ids, ivf, lists, sampling, search, transform
from vectide.schema import Collection, VectorError
from vectide.sources.collection import LOG, DurableCollection, export_json, import_json, live_view, verify_checksum, with_checksum
from vectide.streaming.online import codebooks_of, committed_lengths, follow_centroids, follow_codebooks, ingest_log, state_of

JAN = (datetime(2025, 1, 1, tzinfo=timezone.utc), datetime(2025, 1, 31, 23, 59, 59, tzinfo=timezone.utc))
N = MetadataFilter()


@pytest.mark.parametrize(
    ("metadata", "f", "want"),
    [
        ({"date": "2025-01-15T12:00:00Z"}, N.between(*JAN), True),
        ({"date": "2024-12-31T23:59:59Z"}, N.between(*JAN), False),
        ({"date": "2025-01-15T12:00:00.125Z"}, N.between(*JAN), True),
        ({"date": "2025-02-01T01:30:00+02:00"}, N.between(*JAN), True),
        ({"date": "2025-01-15"}, N.between(*JAN), False),
        ({"date": "soon"}, N.between(*JAN).allow_missing(), False),
        ({}, N.between(*JAN), False),
        ({}, N.between(*JAN).allow_missing(), True),
        (None, N.between(*JAN), False),
        (None, N.between(*JAN).allow_missing(), True),
        ({"tags": "work, journal, mood"}, N.including(["mood"]), True),
        ({"tags": "work, journal, mood"}, N.including(["mood", "sleep"]), True),
        ({"tags": "work, journal, mood"}, N.including(["work", "mood"], True), True),
        ({"tags": "work, journal, mood"}, N.including(["work", "sleep"], True), False),
        ({"tags": "work, journal, mood"}, N.including(["Mood"]), False),
        ({"tags": "work, journal, mood"}, N.excluding(["private"]), True),
        ({"tags": "work, journal, mood"}, N.excluding(["journal"]), False),
        ({"tags": "x,y"}, N.including([]), False),
        ({"tags": "x,y"}, N.including([], True), True),
        ({"tags": "x,y"}, N.excluding([]), True),
        ({"tags": "x;y"}, N.keys(delimiter=";").including(["y"]), True),
        ({}, N.including(["journal"]).allow_missing(), True),
        ({}, N.including(["journal"]), False),
        ({"tags": "journal", "title": "Day 1"}, N.including(["journal"]).also(lambda m: F.length(m["title"]) > 0), True),
        ({"tags": "journal", "title": ""}, N.including(["journal"]).also(lambda m: F.length(m["title"]) > 0), False),
        ({"title": ""}, N.including(["journal"]).allow_missing().also(lambda m: F.length(m["title"]) > 0), True),
    ],
)
def test_metadata_filter(spark, metadata, f, want):
    df = spark.createDataFrame([(metadata,)], "metadata map<string,string>")
    assert df.select(f.column().alias("ok")).first().ok is want


def test_id_sets(spark):
    df = spark.createDataFrame([(i, 10.0 + i) for i in range(8)] + [(99, 0.0)], "id long, score double")
    allow, deny = (spark.createDataFrame([(i,) for i in s], "id long") for s in ([0, 2, 4, 6], [2, 6]))
    assert [tuple(r) for r in id_pass(df, [allow], [deny], 64).orderBy("id").collect()] == [(0, 10.0), (4, 14.0)]
    assert id_pass(df).count() == 9
    assert id_pass(df, denies=[deny], capacity=64).count() == 6
    assert [r.mask for r in id_mask(df, [allow], [deny], 64).orderBy("id").collect()] == [1, 0, 0, 0, 1, 0, 0, 0, 0]


def test_codecs(spark):
    df = spark.createDataFrame([([0.5, -0.5, 1.5, 2.5, 1000.0],)], "v array<double>")
    assert df.select(codecs.quantize_symmetric(F.col("v"), 1.0)).first()[0] == [0, 0, 2, 2, 127]
    assert df.select(codecs.dequantize_affine(codecs.quantize_affine(F.col("v"), 1.0, 3), 1.0, 3)).first()[0] == [0.0, 0.0, 2.0, 2.0, 124.0]
    codes = spark.createDataFrame([([1, 15, 7],)], "c array<int>")
    assert codes.select(codecs.pack_nibbles(F.col("c"))).first()[0] == [0xF1, 7]
    assert codes.select(codecs.unpack_nibbles(codecs.pack_nibbles(F.col("c")))).first()[0] == [1, 15, 7, 0]
    v = spark.createDataFrame([([0.1, 1e9, 3.0],)], "v array<float>")
    assert v.select(codecs.through_float16("v")).first()[0] == [float(np.float16(0.1)), 65504.0, 3.0]
    assert v.select(codecs.through_bfloat16("v")).first()[0][2] == 3.0


def test_layout(spark):
    x = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(11)], "id long, vector array<double>")
    blocks = transform.interleave(x, 4)
    assert blocks.where("block = 0").first()["values"] == [0.0, 1.0, 2.0, 3.0, 0.0, -1.0, -2.0, -3.0]
    assert transform.deinterleave(blocks).orderBy("id").collect() == x.orderBy("id").collect()


def test_id_tables(spark):
    known = ids.assign_ids(spark.createDataFrame([("b",), ("a",)], "external_id string")).cache()
    assert {r.external_id: r.internal_id for r in known.collect()} == {"a": 0, "b": 1}
    more = spark.createDataFrame([("c",)], "external_id string")
    assert {r.external_id: r.internal_id for r in ids.append_ids(known, more).collect()} == {"a": 0, "b": 1, "c": 2}
    again = spark.createDataFrame([("b",)], "external_id string")
    with pytest.raises(VectorError):
        ids.append_ids(known, again)
    assert {r.external_id: r.internal_id for r in ids.append_ids(known, again, replace=True).collect()} == {"a": 0, "b": 2}
    with pytest.raises(VectorError):
        ids.assign_ids(again.union(again))
    assert ids.lookup(more, known).first().internal_id == -1
    assert ids.erase_ids(known, again).count() == 1


def test_list_inserts(spark):
    lists = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (1, 0, 20)], "list_id int, pos long, external_id long")
    new = spark.createDataFrame([(0, 0, 30), (1, 1, 31)], "seq int, list_id int, external_id long")
    assert sorted(tuple(r) for r in ivf.append(lists, new).collect()) == [(0, 0, 10), (0, 1, 11), (0, 2, 30), (1, 0, 20), (1, 1, 31)]
    put = ivf.insert_at(lists, 0, 1, spark.createDataFrame([(0, 5), (1, 6)], "seq int, external_id long"))
    assert [r.external_id for r in put.where("list_id = 0").orderBy("pos").collect()] == [10, 5, 6, 11]
    with pytest.raises(VectorError):
        ivf.insert_at(lists, 0, 9, spark.createDataFrame([(0, 5)], "seq int, external_id long"))
    key = spark.createDataFrame([(7, 2**31 + 5)], "l int, p long").select(ivf.pack_candidate(F.col("l"), F.col("p")).alias("k"))
    assert tuple(key.select(*ivf.unpack_candidate(F.col("k"))).first()) == (7, 2**31 + 5)


def test_collection_life(spark, tmp_path):
    path = str(tmp_path / "c")
    c = DurableCollection.create(spark, path, Collection(2, "cosine", "flat", {"note": 1}))
    c.upsert([("a", [0.0, 0.0], {"k": "1"}), ("b", [1.0, 0.0], None)])
    with pytest.raises(VectorError):
        c.upsert([("c", [1.0, 1.0], None), ("d", [1.0], None)])
    assert c.count() == 2 and c.contains("a") and not c.contains("d")
    assert c.update("a", metadata={"k": "2"}) and not c.update("zz", metadata={})
    assert c.update("b", vector=[5.0, 5.0])
    c.remove(["b", "unknown"])
    again = DurableCollection.open(spark, path)
    assert again.config == c.config
    assert [(r.id, r.vector, r.metadata) for r in again.records().collect()] == [("a", [0.0, 0.0], {"k": "2"})]
    again.compact()
    assert again.log().count() == 0 and again.count() == 1
    again.upsert([("a", [9.0, 9.0], None)])
    assert c.records().first().vector == [9.0, 9.0] and c.records().first().metadata is None
    again.clear()
    assert again.count() == 0 and again.statistics()["count"] == 0
    with pytest.raises(VectorError):
        DurableCollection.open(spark, path, "hnsw")
    with pytest.raises(VectorError):
        DurableCollection.open(spark, str(tmp_path / "none"))


def test_replay_is_idempotent(spark):
    log = spark.createDataFrame([(0, "upsert", "a", [1.0], None), (1, "update", "a", None, {"k": "v"}), (2, "remove", "b", None, None), (3, "update", "b", [1.0], None)], LOG)
    once = live_view(None, log)
    assert [(r.id, r.metadata) for r in once.collect()] == [("a", {"k": "v"})]
    assert live_view(once, log).collect() == once.collect()


def test_json_and_checksums(spark, tmp_path):
    records = spark.createDataFrame([("a", [1.0], {"k": "v"})], "id string, vector array<float>, metadata map<string,string>")
    export_json(records, Collection(1, "dot"), str(tmp_path / "j"))
    back, config = import_json(spark, str(tmp_path / "j"), "flat")
    assert back.collect() == records.collect() and config.metric == "dot"
    with pytest.raises(VectorError):
        import_json(spark, str(tmp_path / "j"), "hnsw")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text("{not json")
    with pytest.raises(VectorError):
        import_json(spark, str(tmp_path / "bad"))
    signed = with_checksum(records.select("id", "vector"))
    assert verify_checksum(signed).count() == 1
    with pytest.raises(VectorError):
        verify_checksum(signed.withColumn("id", F.lit("z")))


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(0, "upsert", "a", [1.0], None)], LOG)
    log.write.parquet(str(tmp_path / "ops"))
    ingest_log(spark.readStream.schema(LOG).parquet(str(tmp_path / "ops")), str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination(60)
    assert live_view(None, spark.read.schema(LOG).parquet(str(tmp_path / "log"))).count() == 1
    frames = spark.createDataFrame([(0, 0, 5, True), (1, 1, 3, True), (0, 2, 9, True), (0, 3, 99, False), (0, 4, 100, True)], "list_id int, seq long, length long, intact boolean")
    assert {r.list_id: r.length for r in committed_lengths(frames).collect()} == {0: 9, 1: 3}


def test_centroids_follow_a_stream_and_survive_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (60, 3))])
    first = spark.createDataFrame([(0, [0.5, 0.5, 0.5]), (1, [7.0, 7.0, 7.0])], "list_id int, centroid array<double>")
    kind = "id long, vector array<double>"

    def run(name, batches, decay, restart):
        source, state, checkpoint = (str(tmp_path / f"{name}-{part}") for part in ("in", "state", "checkpoint"))
        for number, part in enumerate(np.split(x, batches)):
            rows = [(1000 * number + i, [float(v) for v in row]) for i, row in enumerate(part)]
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            if restart or number == batches - 1:  # each call is a query of its own, which goes on from the stored state
                stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
                follow_centroids(stream, first, state, checkpoint, decay).awaitTermination(120)
        return state_of(spark, state)[1].orderBy("list_id").collect()

    once, often = run("once", 4, None, False), run("often", 4, None, True)
    assert np.allclose([r.centroid for r in once], [r.centroid for r in often], atol=1e-12) and [r.n for r in once] == [r.n for r in often] == [60, 60]
    assert np.allclose([r.centroid for r in once], [x[:60].mean(0), x[60:].mean(0)])
    one = run("decay", 1, 0.05, False)
    keep = 0.95**60
    assert np.allclose([r.centroid for r in one], [keep * 0.5 + (1 - keep) * x[:60].mean(0), keep * 7 + (1 - keep) * x[60:].mean(0)])


def test_codebooks_follow_a_stream(spark, tmp_path):
    rows = [(i, [0.1 * i, 0.0, 5.0, 5.0]) for i in range(10)] + [(10 + i, [9.0, 9.0, 1.0, 1.0]) for i in range(10)]
    spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    first = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [8.0, 8.0]), (1, 0, [0.0, 0.0]), (1, 1, [6.0, 6.0])], "sub int, code int, centroid array<double>")
    stream = spark.readStream.schema("id long, vector array<double>").parquet(str(tmp_path / "in"))
    follow_codebooks(stream, first, 2, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {(r["sub"], r["code"]): r["centroid"] for r in codebooks_of(spark, str(tmp_path / "state")).collect()}
    assert np.allclose([got[k] for k in sorted(got)], [[0.45, 0.0], [9.0, 9.0], [1.0, 1.0], [5.0, 5.0]])


def test_codebooks_follow_batches_and_are_mended(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (40, 4)), rng.normal(9, 0.1, (40, 4))])
    x[1::2] = x[1::2] + 4
    start = [[0.0, 0.0], [500.0, 500.0], [501.0, 501.0]]
    first = spark.createDataFrame([(j, c, v) for j in range(2) for c, v in enumerate(start)], "sub int, code int, centroid array<double>")
    kind = "id long, vector array<double>"

    def run(name, restart, **settings):
        source, state, checkpoint = (str(tmp_path / f"{name}-{part}") for part in ("in", "state", "checkpoint"))
        for number in range(6):
            rows = [(1000 * number + i, [float(v) for v in row]) for i, row in enumerate(x)]
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            if restart or number == 5:
                stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
                follow_codebooks(stream, first, 2, state, checkpoint, **settings).awaitTermination(120)
        assert len(list((tmp_path / f"{name}-state").glob("batch=*"))) <= 5
        return np.array([r.centroid for r in codebooks_of(spark, state).orderBy("sub", "code").collect()])

    once, often = run("once", False, decay=0.05), run("often", True, decay=0.05)
    assert np.allclose(once, often, atol=1e-12) and once.max() < 20
    left = run("plain", False, repair=False)
    assert (left.max(1) > 400).sum() == 4
    assert run("thin", False, most=20, decay=0.05).max() < 20


@pytest.mark.parametrize(("kind", "m"), [("pq8", 8), ("pq4", 8), ("pq4", 5)])
def test_list_store(spark, tmp_path, kind, m):
    rows = [(i % 2, 10 + i, i, [(i * 10 + j) % (16 if kind == "pq4" else 256) for j in range(m)]) for i in range(6)]
    df = spark.createDataFrame(rows, "list_id int, external_id long, seq long, codes array<int>")
    store = lists.ingest(lists.ingest(lists.empty(spark), df.where("seq < 3"), kind), df.where("seq >= 3"), kind)
    path = str(tmp_path / "store")
    store.write.partitionBy("list_id").parquet(path)
    got = lists.read_list(spark.read.parquet(path), 1, kind, m).orderBy("pos").collect()
    assert [(r.pos, r.external_id, r.content) for r in got] == [(k, e, c) for k, (_, e, _, c) in enumerate(r for r in rows if r[0] == 1)]
    width = m if kind == "pq8" else (m + 1) // 2
    lengths = spark.createDataFrame([(0,), (1,), (2,)], "list_id int")
    assert sorted(map(tuple, lists.statistics(store, lengths).collect())) == [(0, 3, 3 * width), (1, 3, 3 * width), (2, 0, 0)]


def test_flat_lists_and_unknown_formats(spark):
    df = spark.createDataFrame([(0, 7, 0, [1.5, -2.0]), (0, 8, 1, [0.25, 3.0])], "list_id int, external_id long, seq long, vector array<double>")
    store = lists.ingest(lists.empty(spark), df, "flat", "vector")
    assert [(r.external_id, r.content) for r in lists.read_list(store, 0, "flat").orderBy("pos").collect()] == [(7, [1.5, -2.0]), (8, [0.25, 3.0])]
    with pytest.raises(VectorError):
        lists.pack("zip", F.col("codes"))


def test_ids_are_kept_or_made(spark):
    known = ids.assign_ids(spark.createDataFrame([("a",), ("c",)], "external_id string"))
    got = ids.get_or_create(known, spark.createDataFrame([("c",), ("b",), ("d",), ("b",)], "external_id string"))
    assert sorted(map(tuple, got.collect())) == [("b", 2), ("c", 1), ("d", 3)]
    assert ids.statistics(ids.erase_ids(known.unionByName(got.where("internal_id > 1")), known.limit(0).unionByName(got.where("internal_id = 2")))).first().asDict() == {"held": 3, "largest": 3, "free": 1}


def test_permutation_is_seeded_and_gapless(spark):
    df = spark.range(500)
    one = {r.id: r.position for r in sampling.permutation(df, 3).collect()}
    assert sorted(one.values()) == list(range(500)) and one == {r.id: r.position for r in sampling.permutation(df.repartition(7), 3).collect()}
    assert one != {r.id: r.position for r in sampling.permutation(df, 4).collect()}
    large = spark.range(20_000)
    want = {r.id for r in large.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(1000).collect()}
    assert {r.id for r in sampling.bounded_sample(large, 1000, 5).collect()} == want


def test_searches_are_observed(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, vector array<double>")
    q = spark.createDataFrame([(0, [3.0, 1.0])], "qid long, q array<double>")
    found, seen = search.observed(v.where("id % 2 = 1"), lambda rows: search.batch_knn(rows, q, 2))
    rows, stats = search.with_stats(found, seen, True)
    assert [r.id for r in rows] == [3, 1] and stats["candidates_searched"] == 20 and stats["is_exhaustive"] and stats["search_nanos"] > 0


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_ranges_by_both_ways(spark, metric):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6) * rng.uniform(0.1, 4)]) for i in range(300)], "id long, vector array<double>")
    q = v.where("id < 9").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    limit = {"euclidean": 2.5, "dot": 3.0, "cosine": 0.4}[metric]
    a, b = ({tuple(r) for r in search.range_search(v, q, limit, metric, strategy=how).collect()} for how in ("expr", "arrow"))
    assert a == b and a
    allow, deny = v.where("id % 2 = 0").select("id"), v.where("id % 5 = 0").select("id")
    some = search.range_search(v, q, limit, metric, allow=[allow], deny=[deny], reservoir=3, strategy="arrow").collect()
    assert all(r.id % 2 == 0 and r.id % 5 for r in some) and max(sum(r.qid == k for r in some) for k in range(9)) <= 3
    if metric == "euclidean":
        assert search.range_search(v, q, -1.0, strategy="arrow").count() == 0 == search.range_search(v, q, -1.0, strategy="expr").count()
    short = v.unionByName(spark.createDataFrame([(999, [1.0])], v.schema))
    with pytest.raises(Exception, match="dimension"):
        search.range_search(short, q, limit, metric, strategy="arrow").collect()
