"""Searches whose queries grow with the table: coarse products before exact scores, and what leaves a task."""

import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from vectide.operators import ivf, pq, search, transform
from vectide.operators.nearest import Nearest, one_nearest
from vectide.plans import catalogue
from vectide.schema import VectorError

SF = "/root/testdata/sf0.01"


def crowd(n=1500, seed=1):
    """Vectors with copies, near copies, a zero, and components that are no numbers."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32).astype(float) * rng.integers(1, 11, n)[:, None]
    x[n // 2 : n // 2 + n // 4] = x[: n // 4]
    x[-50:] = x[:50] * (1 + 2.0**-40)
    x[7], x[9, 3], x[11, 2], x[13] = 0, np.nan, np.inf, 1e200
    return x


@pytest.mark.parametrize("raw", [False, True])
@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine", "manhattan", "chebyshev"])
def test_kernel_equals_full_scores(metric, raw):
    x = crowd()
    q, ids = x[::5].copy(), np.random.default_rng(2).permutation(len(x))
    found = Nearest(q, 10, metric, raw)
    for i in range(0, len(x), 400):
        found.add(x[i : i + 400], ids[i : i + 400])
    at, names, d = found.found()
    with np.errstate(all="ignore"):
        want = (search.raw_scores if raw else search.distances)(q, x, metric)
    key = -want if raw and metric in ("dot", "cosine") else want
    for i in range(len(q)):
        some = np.flatnonzero(~np.isnan(key[i]))
        best = some[np.lexsort((ids[some], key[i, some]))[:10]]
        assert list(zip(names[at == i], d[at == i])) == list(zip(ids[best], want[i, best]))


@pytest.mark.parametrize("metric, limit", [("euclidean", 9.0), ("dot", 30.0), ("cosine", 0.4)])
def test_matches_are_all_pairs_in_range(metric, limit):
    x = crowd()
    raw = metric != "euclidean"
    got = {(q, r, d) for part in Nearest(x[::7].copy(), 1, metric, raw, -limit if raw else limit).matches(x) for q, r, d in zip(*part)}
    with np.errstate(all="ignore"):
        want = (search.raw_scores if raw else search.distances)(x[::7], x, metric)
    q, r = np.nonzero(want >= limit if raw else want <= limit)
    assert got == set(zip(q, r, want[q, r])) and len(got) > 100


@pytest.mark.parametrize("metric, limit", [("euclidean", 9.0), ("euclidean", 0.0), ("euclidean", -1.0), ("euclidean", np.inf), ("dot", 30.0), ("cosine", 0.4), ("cosine", -1.0)])
def test_a_tally_scores_only_what_the_product_leaves_open(monkeypatch, metric, limit):
    x, scored = crowd(), []
    raw, whole = metric != "euclidean", Nearest._exact
    monkeypatch.setattr(Nearest, "_exact", lambda self, q, x, at, *more: scored.append(len(at)) or whole(self, q, x, at, *more))
    got = Nearest(x[::7].copy(), 1, metric, raw, -limit if raw else limit).tally(x)
    with np.errstate(all="ignore"):
        want = (search.raw_scores if raw else search.distances)(x[::7], x, metric)
        assert got.tolist() == (want >= limit if raw else want <= limit).sum(1).tolist()
    assert sum(scored) < len(got) * len(x) / 20


def test_counts_of_a_range(spark):
    x = crowd(600)[14:]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    q = c.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    for metric, limit in (("euclidean", 9.0), ("cosine", 0.4), ("manhattan", 30.0)):
        want = search.range_search(c, q, limit, metric).groupBy("qid").count().collect()
        assert want and sorted(map(tuple, search.range_count(c, q, limit, metric).collect())) == sorted(map(tuple, want))
    assert search.range_count(c.where("false"), q, 9.0).count() == 0


def test_distinct_ids_within_a_bound():
    x = np.arange(1000.0).reshape(-1, 1)
    found = Nearest(np.array([[0.0]]), 4, "euclidean", within=900.0, distinct=True)
    found.add(x, np.arange(1000) // 10)
    assert [list(c) for c in found.found()[1:]] == [[0, 1, 2, 3], [0.0, 10.0, 20.0, 30.0]]


def test_the_lowest_of_equal_codes_and_small_memory():
    """a round over 20,000 codes keeps tiles of pairs, not rows times codes (655 MB for 4,096 rows)."""
    rng = np.random.default_rng(3)
    model = np.repeat(rng.normal(size=(10_000, 8)), 2, axis=0)
    x = model[rng.integers(0, 20_000, 4096)]
    tracemalloc.start()
    at, best = one_nearest(x, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (at % 2 == 0).all() and (best == 0).all() and peak < 100_000_000


def test_lists_are_picked_where_queries_stand(spark):
    """no pair of query and centroid becomes a row."""
    v = catalogue.scaled(spark, SF)
    plan = ivf.select_lists(catalogue.centroids(v), catalogue._all_queries(v), 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Window" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["cosine_half_norms", "cosine_stored_norms", "mips_scores", "range_mask", "adc_scan", "adc_scan_u4"])
def test_pairs_are_no_join(spark, name):
    """F1, F2, F6, F7, F8, F25."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name, passes", [("list_ingest_pq4", 0), ("ivf_append", 0), ("rerank_list_reader", 0), ("list_search_pq4", 1), ("list_search_pq8", 1), ("list_search_flat", 1)])
def test_rows_are_placed_once(spark, name, passes):
    """what reads the placed rows twice doesn't place them again; a list search passes over them once."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == passes


def test_pairs_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [3.0, 4.0])], "qid long, q array<double>")
    got = {r.id: r.score for r in transform.mips_scores(rows, asked, 5.0).collect()}
    assert got[1] == 25 + 5.0 - 2 * 11 and got[2] is None and got[3] is None and np.isnan(got[4])


def test_codes_are_made_once_and_blocks_agree(spark, monkeypatch):
    """Codes go in blocks; however many there are, the result is that of the joined tables."""
    v = catalogue.scaled(spark, SF)
    books, asked = catalogue.codebooks(v), catalogue.probes(v)
    codes = pq.encode_in_place(v, books, 8)
    want = pq.adc(codes.select("id", "codes"), pq.lookup_arrays(asked, books, 8), m=8).collect()
    monkeypatch.setattr(pq, "QUERY_BYTES", 4_000)
    assert sorted(pq.adc_scan(codes, asked, books).collect()) == sorted(want)
    assert sorted(pq.adc_scan(codes, asked, books, within=20.0).collect()) == sorted(r for r in want if r.distance <= 20)
    best = {(r.qid, r["rank"]): (r.id, r.distance) for r in pq.nearest_codes(codes, asked, books, 5).collect()}
    for qid in {r.qid for r in want}:
        mine = sorted((r.distance, r.id) for r in want if r.qid == qid)[:5]
        assert [best[qid, i + 1] for i in range(5)] == [(i, d) for d, i in mine]


def test_a_reservoir_bounds_what_leaves_a_task(spark):
    """all 400 copies are in range; a task passes on two a query."""
    rows = spark.range(0, 400, 1, 2).select("id", F.array(*[F.lit(1.0)] * 64).alias("vector"))
    asked = spark.range(20).select(F.col("id").alias("qid"), F.array(*[F.lit(1.0)] * 64).alias("q"))
    near = search._arrow_nearest(rows, asked, "euclidean", 2, within=6.0, distinct=True)
    assert near.count() <= 20 * 2 * near.rdd.getNumPartitions() < 20 * 400
    got = search.range_search(rows, asked, 6.0, first_seen=True, reservoir=2, strategy="arrow").collect()
    assert sorted((r.qid, r.id, r.score) for r in got) == [(q, i, 0.0) for q in range(20) for i in (0, 1)]


def test_residual_tables_are_no_join_of_codes(spark):
    """a table's rows are written where its residual stands."""
    plan = catalogue.QUERIES["pq_lut_residual"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def copies(n, times):
    """Vectors that come again and again, as rows and as queries, in no order."""
    x = np.random.default_rng(8).normal(size=(n, 64))
    return np.random.default_rng(9).permutation(np.tile(x, (times, 1)))


def column_bytes(df, path):
    """Rows, and bytes a row by column, of a written result."""
    df.write.parquet(path)
    found, n = {}, 0
    for f in Path(path).glob("*.parquet"):
        data = parquet.read_metadata(f)
        n += data.num_rows
        for g in range(data.num_row_groups):
            for c in range(data.num_columns):
                part = data.row_group(g).column(c)
                found[part.path_in_schema] = found.get(part.path_in_schema, 0) + part.total_compressed_size
    return n, {c: b / n for c, b in found.items()}


def tables(spark, x, asked):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, q array<double>")


def test_pairs_with_stored_norms_take_few_bytes(spark, tmp_path):
    """scores of copies come in runs, ids in short cycles; dealt without order they took 8.2 bytes a row."""
    x = copies(300, 8)
    rows, asked = tables(spark, x, copies(70, 8))
    n, size = column_bytes(transform.cosine_with_norms(rows, transform.norms(rows), asked), str(tmp_path / "out"))
    assert n == len(x) * 560 and sum(size.values()) < 2


def test_pairs_with_a_radius_take_few_bytes(spark, tmp_path):
    """as for F3; scores of distinct vectors take eight bytes, and the ids of 2,400 rows a task no longer two more."""
    x = np.random.default_rng(8).normal(size=(19_200, 64))
    rows, asked = tables(spark, x, x[:520])
    n, size = column_bytes(transform.mips_scores(rows, asked, 90.0), str(tmp_path / "out"))
    assert n == len(x) * 520 and size["id"] < 0.2 and sum(size.values()) < 8.3


def test_copies_of_odd_vectors_keep_their_own_values(spark):
    """what is scored once is equal bit by bit, with its norm; nulls, signs of zero and norms that differ are told apart."""
    odd = [[1.0, 2.0], [1.0, 2.0], None, [1.0, None], [float("nan"), float("nan")], [0.0, -0.0], [-0.0, 0.0], [0.0, 0.0], [1.0, 2.0, 9.0]] * 3
    rows = spark.createDataFrame([(i, v, float(i % 2 + 1)) for i, v in enumerate(odd)], "id long, vector array<double>, inv_norm double")
    asked = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(search.MANY)], "qid long, q array<double>")
    got = {(r.qid, r.id): r.score for r in transform.cosine_with_norms(rows, None, asked).collect()}
    assert len(got) == len(odd) * search.MANY
    for (qid, i), s in got.items():
        v, q = odd[i], [1.0, float(qid % 3)]
        if v is None or None in v:
            assert s is None
        else:
            want = (0.0 + q[0] * v[0] + q[1] * v[1]) * (1.0 / np.sqrt(q[0] * q[0] + q[1] * q[1])) * (i % 2 + 1)
            assert s == want or np.isnan(s) and np.isnan(want)


def test_distances_of_codes_take_few_bytes(spark, tmp_path, monkeypatch):
    """the ids of a block come in short cycles, not all for each query (12 bytes a row, 8 of them the distance); groups of queries that don't fill a tile are whole."""
    x = np.random.default_rng(8).normal(size=(20_000, 64))
    rows, asked = tables(spark, x, x[:300])
    codes = rows.select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(90)).cast("int") for j in range(8)]).alias("codes"))
    books = pq.sub_vectors(rows.where("id < 90"), 8).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    found = pq.adc_scan(codes, asked, books)
    n, size = column_bytes(found, str(tmp_path / "out"))
    assert n == len(x) * 300 and size["id"] < 0.4 and sum(size.values()) < 8.6
    want = pq.adc(codes.where("id < 700"), pq.lookup_arrays(asked.where("qid < 50"), books, 8), m=8).collect()
    monkeypatch.setattr(pq, "HELD", 5_000)
    few = pq.adc_scan(codes.where("id < 700"), asked.where("qid < 50"), books).collect()
    assert len(want) == 35_000 and sorted(few) == sorted(want)


def test_distances_of_packed_codes_take_few_bytes(spark, tmp_path):
    """rows of equal codes have equal distances, which come in runs wherever the rows stand."""
    rows, asked = tables(spark, copies(400, 10), copies(40, 10))
    books = pq.sub_vectors(rows.where("id < 16"), 8).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    codes = pq.encode_in_place(rows, books, 8)
    n, size = column_bytes(pq.adc_scan(codes, asked, books, bias=1.5), str(tmp_path / "out"))
    assert n == 4_000 * 400 and sum(size.values()) < 1.5


def test_residual_tables_take_few_bytes(spark, tmp_path):
    """a query that is a centroid has the residual 0, as all such; their tables come in runs, and codes in short cycles."""
    x = np.random.default_rng(8).normal(size=(300, 64))
    rows, asked = tables(spark, x, x)
    centroids = rows.select(F.col("id").cast("int").alias("list_id"), F.col("vector").alias("centroid"))
    books = pq.sub_vectors(rows, 8).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    probes = asked.select("qid", F.explode(F.array(F.col("qid"), (F.col("qid") + 7) % 300)).alias("list_id")).withColumn("list_id", F.col("list_id").cast("int"))
    found = pq.residual_lookup_tables(asked, probes, centroids, books, 8)
    n, size = column_bytes(found, str(tmp_path / "out"))
    assert n == 600 * 8 * 300 and sum(size.values()) < 5.5
    own = {(r.sub, r.code): r.d for r in found.where("qid = 4 and list_id = 4").collect()}
    assert len(own) == 2400 and all(own[j, c] == search._norms(x[c : c + 1, j * 8 : j * 8 + 8])[0] for j, c in own)


def test_lookup_tables_are_no_join_and_take_few_bytes(spark, tmp_path):
    """tables were joined by sub-space, so that with more codes than are broadcast m tasks made them all, and from one file one task."""
    rows, asked = tables(spark, copies(100, 8), copies(60, 6))
    books = pq.sub_vectors(rows, 8).select("sub", F.col("id").cast("int").alias("code"), F.col("part").alias("centroid"))
    found = pq.lookup_tables(asked.coalesce(1), books, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    n, size = column_bytes(found, str(tmp_path / "out"))
    assert n == 360 * 8 * 800 and sum(size.values()) < 1.5
    assert len(list((tmp_path / "out").glob("*.parquet"))) > 1


@pytest.mark.parametrize("with_norm", [True, False])
def test_lookup_tables_of_odd_queries(spark, with_norm):
    """by value; codes with gaps, parts without a number, null and short vectors."""
    books = spark.createDataFrame([(0, 3, [0.5, -1.0]), (0, 7, [0.0, -0.0]), (1, 2, [2.0, 2.0]), (1, 9, [2.0, 2.0]), (5, 0, [1.0, 1.0])], "sub int, code long, centroid array<double>")
    vectors = {1: [1.0, 2.0, 3.0, 4.0], 2: [1.0, None, 3.0, 4.0], 3: None, 4: [1.0, 2.0, 3.0], 5: [float("nan"), 2.0, 3.0, 4.0], 6: [1.0, 2.0, 3.0, 4.0], 7: [1.0, 2.0, 3.0, 4.0, 9.0]}
    asked = spark.createDataFrame(list(vectors.items()), "qid int, q array<double>")
    found = pq.lookup_tables(asked, books, 2, with_norm=with_norm)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("qid", "int"), ("sub", "int"), ("code", "bigint"), ("d", "double")]
    got = {(r.qid, r.sub, r.code): r.d for r in found.collect()}
    assert len(got) == found.count() == 7 * 4
    for (qid, sub, code), d in got.items():
        part = ((vectors[qid] or []) + [None] * 4)[sub * 2 : sub * 2 + 2]
        c = {3: [0.5, -1.0], 7: [0.0, -0.0]}.get(code, [2.0, 2.0])
        if None in part:
            assert d is None
            continue
        want = sum((a - b) * (a - b) if with_norm else b * b - 2 * a * b for a, b in zip(part, c))
        assert d == want or np.isnan(d) and np.isnan(want)
    assert pq.lookup_tables(asked.where("false"), books, 2).count() == 0
    with pytest.raises(VectorError):
        pq.lookup_tables(asked.where("qid = 1"), books, 3).count()
