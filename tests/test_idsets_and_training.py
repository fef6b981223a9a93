"""Bitmap id sets, sketched look-ups, codebooks over all rows, lists that follow a collection."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import ids, idsets, ivf, pq, transform
from vectide.schema import Collection, VectorError
from vectide.sources.collection import DurableCollection
from vectide.sources.listed import ListIndex


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def members(spark, s, universe):
    return {r.id for r in idsets.contains(numbers(spark, universe), s).where("mask").collect()}


def test_bitmaps_are_sets(spark):
    rng = random.Random(1)
    universe = [*range(-40, 400), 32_767, 32_768, 32_769, 10**9, 2**40, -70_000]
    a, b = (set(rng.sample(universe, 150)) for _ in range(2))
    x, y = (idsets.build(numbers(spark, [*s, *list(s)[:9], None])) for s in (a, b))
    assert members(spark, x, universe) == a and idsets.count(x).first().kept == len(a)
    for made, want in ((idsets.union(x, y), a | b), (idsets.intersect(x, y), a & b), (idsets.subtract(x, y), a - b)):
        assert members(spark, made, universe) == want and idsets.count(made).first().kept == len(want)
    changed = idsets.clear_ids(idsets.set_ids(x, numbers(spark, [5, 6, 2**40])), numbers(spark, [6, 7, 999]))
    assert members(spark, changed, universe) == (a | {5, 6, 2**40}) - {6, 7}
    rows = numbers(spark, [*universe, 5, None])
    for allow, deny, want in (([x], [y], a - b), ([x, y], [], a & b), ([], [x, y], set(universe) - a - b), ([], [], set(universe))):
        got = [r.id for r in idsets.id_pass(rows, allow, deny).collect()]
        assert {i for i in got if i is not None} == want and got.count(5) == 2 * (5 in want) and (None in got) == (not allow)
    none = idsets.build(numbers(spark, []))
    assert idsets.count(none).first().kept == 0 and members(spark, none, universe) == set() and idsets.subtract(x, x).count() == 0


def test_large_sets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(idsets, "BROADCAST", 0)
    s = idsets.build(spark.range(0, 200_000, 3).toDF("id"))
    assert idsets.contains(spark.range(1000).toDF("id"), s).where("mask").count() == 334 and idsets.count(s).first().kept == 66_667


def test_sketches_stop_unknown_ids(spark, monkeypatch):
    known = ids.assign_ids(spark.range(3000).select(F.concat(F.lit("k"), "id").alias("external_id")))
    asked = spark.range(1000, 9000).select(F.concat(F.lit("k"), "id").alias("external_id"), F.col("id").alias("n")).union(spark.createDataFrame([(None, -5)], "external_id string, n long"))
    want = sorted((r.n, r.internal_id) for r in ids.lookup(asked, known).collect())
    assert sorted((r.n, r.internal_id) for r in ids.lookup_sketched(asked, known).collect()) == want
    bits = ids.sketch(known)
    assert known.where(~ids.may_hold(bits, F.col("external_id"))).count() == 0
    unknown = asked.where("n >= 3000")
    stopped = unknown.where(~ids.may_hold(bits, F.col("external_id"))).count()
    assert stopped >= 0.95 * unknown.count()
    monkeypatch.setattr(ids, "SKETCH_BYTES", 10)
    assert ids.sketch(known) is None and sorted((r.n, r.internal_id) for r in ids.lookup_sketched(asked, known).collect()) == want


def test_erased_numbers_are_not_given_again(spark):
    known = ids.assign_ids(spark.createDataFrame([(c,) for c in "abcd"], "external_id string"))
    erased = ids.erase_ids(known, spark.createDataFrame([("d",), ("zz",)], "external_id string"), tombstones=True)
    assert {r.external_id for r in ids.live_ids(erased).collect()} == set("abc")
    more = ids.append_ids(erased.drop("erased"), spark.createDataFrame([("e",)], "external_id string"))
    assert {r.external_id: r.internal_id for r in more.collect()}["e"] == 4
    got = {r.external_id: r.internal_id for r in ids.lookup_sketched(spark.createDataFrame([("a",), ("d",)], "external_id string"), erased).collect()}
    assert got["d"] == -1 and got["a"] >= 0
    again = ids.erase_ids(erased, spark.createDataFrame([("a",)], "external_id string"), tombstones=True)
    assert ids.statistics(again).first()["held"] == 2


def parts(x, m):
    return [x[:, j * x.shape[1] // m : (j + 1) * x.shape[1] // m] for j in range(m)]


def lloyd_by_hand(x, m, start, rounds):
    out = []
    for part, c in zip(parts(x, m), start):
        c = c.copy()
        for _ in range(rounds):
            at = ((part[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for k in range(len(c)):
                if (at == k).any():
                    c[k] = part[at == k].mean(0)
        out.append(c)
    return np.array(out)


def vectors(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)


def table(spark, books):
    return spark.createDataFrame([(j, c, list(map(float, v))) for j, b in enumerate(books) for c, v in enumerate(b)], "sub int, code int, centroid array<double>")


def test_training_over_all_rows_is_lloyds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 12))
    start = np.array([p[:8] for p in parts(x, 3)])
    books, seen = pq.train_all(vectors(spark, x), 3, 8, rounds=6, tolerance=0.0, empty="ignore", start=table(spark, start))
    assert np.allclose(pq.books_of(books), lloyd_by_hand(x, 3, start, 6))
    assert all(b <= a + 1e-9 for a, b in zip(seen, seen[1:])) and len(seen) == 7
    assert abs(seen[-1] - pq.distortion(pq.encode(vectors(spark, x), books, 3)).first()[0]) < 1e-9
    # going on from a model is as good as having gone on
    half, _ = pq.train_all(vectors(spark, x), 3, 8, rounds=3, tolerance=0.0, empty="ignore", start=table(spark, start))
    assert np.allclose(pq.books_of(pq.train_all(vectors(spark, x), 3, 8, rounds=3, tolerance=0.0, empty="ignore", start=half)[0]), pq.books_of(books))
    assert len(pq.train_all(vectors(spark, x), 3, 8, rounds=40, tolerance=0.05)[1]) < 10


@pytest.mark.parametrize("empty", ["split", "reseed", "ignore"])
def test_codes_without_rows_are_mended(spark, empty):
    rng = np.random.default_rng(7)
    centers = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], float)
    x = np.concatenate([c + rng.normal(0, 0.1, (60, 2)) for c in centers])
    start = np.array([[[5.0, 5.0], [900.0, 900.0], [901.0, 901.0], [902.0, 902.0]]])
    books, seen = pq.train_all(vectors(spark, x), 1, 4, rounds=20, empty=empty, start=table(spark, start))
    used = pq.encode(vectors(spark, x), books, 1).select("code").distinct().count()
    assert used == (1 if empty == "ignore" else 4) and (seen[-1] < 1 or empty == "ignore")
    with pytest.raises(VectorError):
        pq.train_all(vectors(spark, x), 1, 4, empty="drop")
    with pytest.raises(VectorError):
        pq.train_all(vectors(spark, x[:3]), 1, 4)
    with pytest.raises(VectorError):
        pq.train_all(vectors(spark, x), 1, 3, start=table(spark, start))


def test_training_on_residuals(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(200, 4)) + 50, rng.normal(size=(200, 4)) - 50])
    c = vectors(spark, x)
    centroids = spark.createDataFrame(ivf.train(c, 2).collect(), "list_id int, centroid array<double>")
    placed = ivf.build(c, centroids)
    whole, rest = pq.train_all(c, 2, 8, rounds=8)[1][-1], pq.train_all(placed, 2, 8, rounds=8, centroids=centroids)
    assert rest[1][-1] < whole
    coded = pq.encode(transform.residuals(placed, centroids).select("id", F.col("residual").alias("vector")), rest[0], 2)
    assert abs(pq.distortion(coded).first()[0] - rest[1][-1]) < 1e-6


def test_lists_follow_a_collection(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    record = lambda i, v: (f"r{i}", list(map(float, v)), {"even": str(i % 2 == 0)})
    c = DurableCollection.create(spark, str(tmp_path / "c"), Collection(4))
    c.upsert([record(i, v) for i, v in enumerate(x[:200])])
    index = ListIndex.create(c, str(tmp_path / "l"), 6)

    def same():
        rebuilt = ivf.build(c.records(), index.centroids())
        key = lambda r: (r.id, r.list_id, tuple(r.vector))
        assert sorted(map(key, index.lists().collect())) == sorted(map(key, rebuilt.collect()))

    same()
    assert index.follow() == 0
    c.upsert([record(i, x[200]) for i in (1, 2)])  # one list gains, a few lose
    c.remove(["r5", "unknown"])
    assert index.statistics()["behind"] == 2
    assert 1 <= index.follow() <= 4
    same()
    c.upsert([record(200 + i, v) for i, v in enumerate(x[200:])])
    c.update("r9", metadata={"even": "no"})
    c.compact()
    index = ListIndex.open(c, index.path)
    index.follow()
    same()
    assert index.lists().where("id = 'r9'").first().metadata == {"even": "no"}
    q = spark.createDataFrame([(0, list(map(float, x[7])))], "qid int, q array<double>")
    assert index.search(q, 1, 6).first().id == "r7"
    assert index.search(q, 5, 6, F.col("metadata")["even"] == "True").where("cast(substr(id, 2) as int) % 2 = 1").count() == 0
    before = index.centroids().collect()
    index.compact()
    assert index.centroids().collect() == before
    same()
    index = ListIndex.open(c, index.path, retrain=True)
    assert index.centroids().collect() != before
    same()
    c.clear()
    c.upsert([record(1, x[1])])
    index.follow()
    same()
    assert index.statistics()["count"] == 1 and index.statistics()["behind"] == 0
    empty = DurableCollection.create(spark, str(tmp_path / "e"), Collection(4))
    assert ListIndex.create(empty, str(tmp_path / "el"), 3).search(q, 2, 2).count() == 0
    with pytest.raises(VectorError):
        ListIndex.open(c, str(tmp_path / "none"))
