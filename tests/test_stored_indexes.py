"""Logs with several writers, stored graphs, and lists that follow a collection."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import hnsw, search
from vectide.operators.sampling import Lcg
from vectide.schema import Collection, VectorError
from vectide.sources.collection import DurableCollection
from vectide.sources.commits import CommitLog
from vectide.sources.graphs import DurableGraph


def rows(spark, x, first=0, parts=3):
    return spark.createDataFrame([(first + i, list(map(float, v))) for i, v in enumerate(x)], "id long, vector array<float>").repartition(parts)


def asked(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "qid int, q array<float>")


def test_scopes_clear_their_tables(spark):
    import os

    from vectide.sources.store import scratch, stored

    with scratch(spark):
        a = stored(spark.range(3))
        with scratch(spark):
            b = stored(a)
            assert b.count() == 3
        assert a.count() == 3
    kept = stored(spark.range(2))
    gone = [df.inputFiles()[0][len("file://") :] for df in (a, b)]
    assert not any(map(os.path.exists, gone)) and kept.count() == 2


def test_two_writers_lose_and_mix_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "writer int, n int"
    log = CommitLog(spark, path, spark.createDataFrame([], schema).schema)
    assert log.last() == -1 and log.rows().count() == 0

    def write(w):
        own = CommitLog(spark, path, log.schema)
        for batch in range(4):
            own.append(spark.createDataFrame([(w, batch * 10 + i) for i in range(10)], schema))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = log.rows().collect()
    assert sorted((r.writer, r.n) for r in got) == [(w, n) for w in range(3) for n in range(40)]
    by = {}
    for r in got:
        by.setdefault(r.batch, set()).add((r.writer, r.n // 10))
    assert sorted(by) == list(range(12)) and all(len(v) == 1 for v in by.values())
    for w in range(3):  # a writer's batches keep their order
        mine = sorted((b, n) for b, v in by.items() for x, n in v if x == w)
        assert [n for _, n in mine] == [0, 1, 2, 3]
    assert log.rows(after=9).select("batch").distinct().count() == 2
    log.forget(5)
    assert log.last() == 11 and sorted({r.batch for r in log.rows().collect()}) == list(range(6, 12))


def test_torn_tails_are_passed_over(spark, tmp_path):
    path = tmp_path / "log"
    log = CommitLog(spark, str(path), spark.createDataFrame([], "n int").schema)
    for i in range(3):
        log.append(spark.createDataFrame([(i,)], "n int"))
    commits = sorted((path / "commits").glob("*.json"))
    commits[2].write_text('{"da')
    assert sorted(r.n for r in log.rows().collect()) == [0, 1]
    assert log.append(spark.createDataFrame([(7,)], "n int")) == 3
    with pytest.raises(VectorError) as e:
        log.rows()
    assert e.value.kind == "corrupted_data"


def test_collections_take_two_writers(spark, tmp_path):
    path = str(tmp_path / "c")
    DurableCollection.create(spark, path, Collection(1))
    writers = [threading.Thread(target=lambda w=w: [DurableCollection.open(spark, path).upsert([(f"{w}-{i}", [float(i)], None), ("shared", [float(w)], None)]) for i in range(3)]) for w in range(2)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    c = DurableCollection.open(spark, path)
    assert {r.id for r in c.records().collect()} == {f"{w}-{i}" for w in range(2) for i in range(3)} | {"shared"}
    last = c.log().where("id = 'shared'").orderBy(F.desc("batch"), F.desc("seq")).first()
    assert c.records().where("id = 'shared'").first().vector == last.vector
    c.compact()
    c.remove(["shared"])
    assert c.log().count() == 1 and c.count() == 6


def state(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_a_reopened_graph_is_the_graph_of_all_steps(spark, tmp_path, metric):
    x, settings = Lcg(31).vectors(240, 12), hnsw.Settings(8, 40, 40)
    paths = [str(tmp_path / n) for n in ("once", "stored", "cut")]
    graphs = [DurableGraph.create(spark, p, rows(spark, x[:100]), metric, settings, 60) for p in paths]
    steps = [
        lambda g: g.insert(rows(spark, x[100:160], 100, 1)),
        lambda g: g.remove(spark.range(0, 160, 9).toDF("id")),
        lambda g: g.insert(rows(spark, x[200:230], 70, 1)),
        lambda g: g.remove([75, 999, 110]),
    ]
    for i, step in enumerate(steps):
        for g in graphs:
            step(g)
        if i % 2 == 0:
            graphs[1].checkpoint()
            graphs[1] = DurableGraph.open(spark, paths[1])
    # a batch that was being written when the third one's machine went down
    graphs[2].insert(rows(spark, x[230:], 500, 1))
    last = sorted((tmp_path / "cut/log/commits").glob("*.json"))[-1]
    last.write_text(last.read_text()[:5])
    graphs[2] = DurableGraph.open(spark, paths[2])
    want = state(graphs[0].graphs())
    assert state(graphs[1].graphs()) == want and state(graphs[2].graphs()) == want
    assert graphs[1].statistics()["count"] == graphs[0].statistics()["count"] and graphs[1].statistics()["log_rows"] < graphs[0].statistics()["log_rows"]
    live = {i: v for i, v in enumerate(x[:160])} | {70 + i: v for i, v in enumerate(x[200:230])}
    live = {i: v for i, v in live.items() if i not in (75, 110) and not (i % 9 == 0 and not 70 <= i < 100)}
    assert {r.id for r in hnsw.vectors(graphs[0].graphs()).collect()} == set(live)
    found = graphs[0].search(asked(spark, x[:20]), 5).collect()
    assert {r.id for r in found} <= set(live)


def test_only_touched_shards_are_written(spark, tmp_path):
    x, path = Lcg(8).vectors(200, 8), tmp_path / "g"
    g = DurableGraph.create(spark, str(path), rows(spark, x), "euclidean", hnsw.Settings(8, 40, 40), 50)
    shard = spark.createDataFrame([(3,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(4)).alias("s")).first().s
    g.remove([3])
    g.checkpoint()
    assert [p.name for p in (path / "graphs/gen=1").glob("shard=*")] == [f"shard={shard}"]
    g.compact()
    assert [p.name for p in (path / "graphs/gen=2").glob("shard=*")] == [f"shard={shard}"] and g.statistics()["tombstones"] == 0
    before = g.meta["generation"]
    g.checkpoint(), g.compact()
    assert g.meta["generation"] == before  # nothing to do


def test_recall_after_removals_and_inserts(spark, tmp_path):
    x, q = Lcg(5).vectors(900, 16), Lcg(6).vectors(30, 16)
    g = DurableGraph.create(spark, str(tmp_path / "g"), rows(spark, x[:700]), "euclidean", hnsw.Settings(12, 80, 80), 300)
    g.insert(rows(spark, x[700:], 700))
    g.remove([i for i in range(900) if i % 10 == 4])
    live = rows(spark, x).where("id % 10 <> 4")
    exact = {(r.qid, r.id) for r in search.batch_knn(live, asked(spark, q), 10).collect()}
    for _ in range(2):
        found = {(r.qid, r.id) for r in g.search(asked(spark, q), 10).collect()}
        assert len(found & exact) >= 0.9 * len(exact) and not any(i % 10 == 4 for _, i in found)
        g.compact()
    degree = hnsw.edges(g.graphs()).groupBy("shard", "level", "src").count().agg(F.max("count")).first()[0]
    assert degree <= 12
    allowed = live.where("id < 50").select("id")
    assert {r.id for r in g.search(asked(spark, q), 5, allowed).collect()} <= set(range(50))


def test_shards_that_outgrow_are_dealt_anew(spark, tmp_path):
    x = Lcg(2).vectors(130, 6)
    g = DurableGraph.create(spark, str(tmp_path / "g"), rows(spark, x[:0]), "euclidean", hnsw.Settings(6, 30, 30), 20, dimension=6)
    assert g.search(asked(spark, x[:2]), 3).count() == 0
    g.insert(rows(spark, x))
    assert g.statistics()["count"] == 130 and g.shards == 1
    g.compact()
    assert g.shards == 7 and DurableGraph.open(spark, g.path).statistics()["count"] == 130
    with pytest.raises(VectorError):
        g.insert(rows(spark, [[1.0]], 999))
    with pytest.raises(VectorError):
        DurableGraph.open(spark, str(tmp_path / "none"))


def test_compaction_keeps_all_nodes_reachable():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    g = hnsw.build_graph(rng.normal(size=(300, 5)), "euclidean", hnsw.Settings(4, 30, 30))
    g.dead[rng.permutation(300)[:200]] = True
    ids, new = hnsw.without_tombstones(pa.array(range(300)), g)
    assert len(ids) == 100 and max(len(ns) for levels in new.edges for ns in levels) <= 4
    seen, todo = {new.entry}, [new.entry]
    while todo:
        for n in new.edges[todo.pop()][0]:
            if n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) == 100
    everyone = hnsw.without_tombstones(pa.array([1, 2]), hnsw.build_graph(rng.normal(size=(2, 3))))[0]
    assert everyone.to_pylist() == [1, 2]
