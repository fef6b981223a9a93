"""Queries over the driver's tables, each with the SQL that gives the same rows.

Searches take as queries every vector whose id is divisible by 20, against all vectors; those
vectors also serve as fixed centroids and codebooks, so that each step can be compared by value.
Trained and graph-based searches have no SQL; the tests hold their recall against exact search.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import codecs, metrics
from vectide.functions.filters import MetadataFilter, id_mask, id_overlay, id_pass
from vectide.operators import hnsw, ids, idsets, ivf, kmeans, lists, pq, readers, sampling, search, topk, transform
from vectide.operators.telemetry import Telemetry
from vectide.plans import sql as S
from vectide.sources.collection import live_view
from vectide.sources.graphs import DurableGraph
from vectide.sources.store import fresh_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

METRICS = {"l2": "euclidean", "cosine": "cosine", "dot": "dot", "l1": "manhattan", "linf": "chebyshev"}
M, WIDTH = 8, 8


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a query; whole numbers come out as 64-bit ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name) for f in df.schema])

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("vector"), "label")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def probes(v: DataFrame) -> DataFrame:
    return v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))


def centroids(v: DataFrame) -> DataFrame:
    return v.where("id % 20 = 0").select(F.expr("cast(id div 20 as int)").alias("list_id"), F.col("vector").alias("centroid"))


def codebooks(v: DataFrame, codes: int | None = None) -> DataFrame:
    rows = v.where("id % 20 = 0" + (f" and id < {20 * codes}" if codes else ""))
    return pq.sub_vectors(rows, M).select("sub", F.expr("cast(id div 20 as int)").alias("code"), F.col("part").alias("centroid"))


# searches


def _knn(metric):
    def run(spark, sf):
        v = scaled(spark, sf)
        return search.knn(v, v.where("id = 0").first().vector, 10, metric)

    return run


for short, metric in METRICS.items():
    dist = S.distance(metric, "q.v", "e.v")
    add(f"knn_{short}", _knn(metric), f"WITH {S.SCALED}, d AS (SELECT e.id, {dist} AS distance FROM emb q, emb e WHERE q.id = 0) SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, distance FROM d ORDER BY distance, id LIMIT 10")
    add(
        f"batch_knn_{short}",
        lambda spark, sf, metric=metric: search.batch_knn(v := scaled(spark, sf), probes(v), 10, metric),
        f"WITH {S.SCALED}, d AS (SELECT q.id AS qid, e.id, {dist} AS distance FROM emb q, emb e WHERE q.id % 20 = 0) SELECT qid, rank, id, distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 10",
    )

_L2 = S.distance("euclidean", "q.v", "e.v")
_PAIRS = f"d AS (SELECT q.id AS qid, e.id, e.label, {_L2} AS distance FROM emb q, emb e WHERE q.id % 20 = 0)"


def _arrow_knn(spark, sf):
    v = scaled(spark, sf)
    return search.batch_knn(v, probes(v), 10, "euclidean", strategy="arrow").select("qid", "rank", "id", F.round("distance", 9).alias("distance"))


add("batch_knn_arrow", _arrow_knn, f"WITH {S.SCALED}, {_PAIRS} SELECT qid, rank, id, round(distance, 9) AS distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 10")


def _filtered(spark, sf):
    v = scaled(spark, sf).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return search.batch_knn(v, probes(v), 10, where=F.try_element_at("metadata", F.lit("label")).isin("1", "3", "5"))


add("filtered_knn", _filtered, f"WITH {S.SCALED}, {_PAIRS} SELECT qid, rank, id, distance FROM {S.ranked('(SELECT * FROM d WHERE label IN (1, 3, 5))', 'distance, id')} WHERE rank <= 10")
add(
    "post_filtered_knn",
    lambda spark, sf: search.batch_knn(v := scaled(spark, sf), probes(v), 10, where=F.col("label") < 3, filter_mode="post"),
    f"WITH {S.SCALED}, {_PAIRS} SELECT qid, rank, id, distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 10 AND label < 3",
)
_GRAPH = "d AS (SELECT q.id AS qid, e.id, {dist} AS distance FROM emb q, emb e WHERE q.id <> e.id)"
add(
    "knn_graph_l2",
    lambda spark, sf: search.knn_graph(scaled(spark, sf), 5),
    f"WITH {S.SCALED}, {_GRAPH.format(dist=_L2)} SELECT qid AS src, rank, id AS dst, distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 5",
)
add(
    "knn_graph_cosine_chord",
    lambda spark, sf: search.knn_graph(scaled(spark, sf), 5, "cosine"),
    f"WITH {S.SCALED}, {_GRAPH.format(dist=S.distance('cosine', 'q.v', 'e.v'))} SELECT qid AS src, rank, id AS dst, sqrt(greatest(0.0::DOUBLE, distance * 2)) AS distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 5",
)

# re-ranking: each query's candidates are 40 ids, some of which have no vector


def _candidates(v: DataFrame) -> DataFrame:
    rows = v.agg((F.max("id") + 101).alias("n"))  # one row: the ids, and a hundred that have no vector
    each = probes(v).select("qid", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pos")).join(F.broadcast(rows))
    return each.select("qid", "pos", ((F.col("qid") * 7 + F.col("pos") * 131) % F.col("n")).alias("id"))


_CAND = "can AS (SELECT q.id AS qid, p.pos, (q.id * 7 + p.pos * 131) % (SELECT max(id) + 101 FROM emb) AS id FROM emb q, (SELECT unnest(range(0, 40)) AS pos) p WHERE q.id % 20 = 0)"


def _rerank_sql(metric: str) -> str:
    return f"sc AS (SELECT can.qid, can.pos, can.id, {S.score(metric, 'q.v', 'e.v')} AS score, e.id IS NOT NULL AS present FROM can JOIN emb q ON q.id = can.qid LEFT JOIN emb e ON e.id = can.id)"


add(
    "rerank_scores",
    lambda spark, sf: search.rerank_scores(_candidates(v := scaled(spark, sf)), v, probes(v), "dot"),
    f"WITH {S.SCALED}, {_CAND}, {_rerank_sql('dot')} SELECT qid, pos, id, CASE WHEN present THEN score ELSE '-infinity'::DOUBLE END AS score, present FROM sc",
)
for name, metric, direction in (("rerank_topk", "euclidean", ""), ("rerank_topk_batch", "cosine", " DESC")):
    add(
        name,
        lambda spark, sf, metric=metric: search.rerank_top_k(_candidates(v := scaled(spark, sf)), v, probes(v), 5, metric),
        f"WITH {S.SCALED}, {_CAND}, {_rerank_sql(metric)} SELECT qid, rank, id, score FROM {S.ranked('(SELECT * FROM sc WHERE present)', f'score{direction}, id')} WHERE rank <= 5",
    )

# ranges

for name, metric, limit in (("range_l2", "euclidean", 4.0), ("range_ip", "dot", 8.0), ("range_cosine", "cosine", 0.3)):
    value = f"sqrt({S.l2sq('q.v', 'e.v')})" if metric == "euclidean" else S.score(metric, "q.v", "e.v")
    inside = f"score {'<=' if metric == 'euclidean' else '>='} {limit}"
    base = f"WITH {S.SCALED}, d AS (SELECT q.id AS qid, e.id, {value} AS score FROM emb q, emb e WHERE q.id % 20 = 0)"
    add(name, lambda spark, sf, metric=metric, limit=limit: search.range_search(v := scaled(spark, sf), probes(v), limit, metric), f"{base} SELECT qid, id, score FROM d WHERE {inside}")
    if metric == "euclidean":
        add("range_mask", lambda spark, sf: search.range_mask(v := scaled(spark, sf), probes(v), 4.0), f"{base} SELECT qid, id, ({inside})::BIGINT AS mask FROM d")
        add("range_first", lambda spark, sf: search.range_search(v := scaled(spark, sf), probes(v), 4.0, most=7), f"{base} SELECT qid, id, score FROM {S.ranked(f'(SELECT * FROM d WHERE {inside})', 'id')} WHERE rank <= 7")

# metadata filters over all events


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    date = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    tags = F.when(F.col("event_id") % 11 != 0, F.concat_ws(" , ", "event_type", F.concat(F.lit("u"), F.col("user_id") % 5), F.lit("")))
    pairs = F.filter(F.array(F.struct(F.lit("date").alias("k"), date.alias("v")), F.struct(F.lit("tags").alias("k"), tags.alias("v"))), lambda p: p.v.isNotNull())
    return e.select("event_id", "value", F.when(F.col("event_id") % 13 != 0, F.map_from_entries(pairs)).alias("metadata"))


_EV = "ev AS (SELECT event_id, value, event_id % 13 = 0 AS no_map, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS date, CASE WHEN event_id % 11 <> 0 THEN [event_type, 'u' || (user_id % 5)] END AS tags FROM events)"
_JAN = (datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 20, 12, tzinfo=timezone.utc))
_DATE = "date BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"


def _filter(name: str, f: MetadataFilter, condition: str) -> None:
    add(name, lambda spark, sf: _events(spark, sf).where(f.column()).select("event_id"), f"WITH {_EV} SELECT event_id FROM ev WHERE {condition}")


_filter("filter_date_between", MetadataFilter().between(*_JAN), f"NOT no_map AND {_DATE}")
_filter("filter_tags_any", MetadataFilter().including(["click", "u3"]), "NOT no_map AND list_has_any(tags, ['click', 'u3'])")
_filter("filter_tags_all", MetadataFilter().including(["click", "u3"], every=True), "NOT no_map AND list_has_all(tags, ['click', 'u3'])")
_filter("filter_tags_exclude", MetadataFilter().excluding(["error"]), "NOT no_map AND NOT list_has_any(tags, ['error'])")
_filter(
    "filter_missing_keys",
    MetadataFilter().between(*_JAN).including(["view"]).allow_missing().also(lambda m: F.length(F.try_element_at(m, F.lit("tags"))) > 12),
    f"no_map OR ((date IS NULL OR {_DATE}) AND (tags IS NULL OR (list_has_any(tags, ['view']) AND length(array_to_string(list_append(tags, ''), ' , ')) > 12)))",
)

# id sets over all orders: customers as ids


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("score"))


def _segment(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return _read(spark, sf, "customer").where(F.col("c_mktsegment").isin(*names)).select(F.col("c_custkey").alias("id"))


def _rich(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))


_ORD = "o AS (SELECT o_custkey AS id, o_orderkey AS pos, o_totalprice AS score FROM orders)"
_SEG = "id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ({}))"
_RICH = "id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
#: The sets' domain reaches to the largest id of an order.
_IN = "id BETWEEN 0 AND (SELECT max(o_custkey) FROM orders)"


def _capacity(spark: SparkSession, sf: str) -> int:
    return _read(spark, sf, "orders").agg(F.max("o_custkey")).first()[0] + 1


_BUILD, _AUTO = _SEG.format("'BUILDING'"), _SEG.format("'AUTOMOBILE', 'MACHINERY'")
add("id_allow", lambda s, f: id_pass(_orders(s, f), [_segment(s, f, "BUILDING")], capacity=_capacity(s, f)), f"WITH {_ORD} SELECT id, pos, score FROM o WHERE {_IN} AND {_BUILD}")
add("id_deny", lambda s, f: id_pass(_orders(s, f), denies=[_segment(s, f, "BUILDING")], capacity=_capacity(s, f)), f"WITH {_ORD} SELECT id, pos, score FROM o WHERE {_IN} AND NOT {_BUILD}")
add("id_allow_deny", lambda s, f: id_pass(_orders(s, f), [_rich(s, f)], [_segment(s, f, "AUTOMOBILE", "MACHINERY")], _capacity(s, f)), f"WITH {_ORD} SELECT id, pos, score FROM o WHERE {_IN} AND {_RICH} AND NOT {_AUTO}")
add("id_mask", lambda s, f: id_mask(_orders(s, f), [_rich(s, f)], [_segment(s, f, "BUILDING")], _capacity(s, f)).select("pos", "mask"), f"WITH {_ORD} SELECT pos, ({_IN} AND {_RICH} AND NOT {_BUILD})::BIGINT AS mask FROM o")
add(
    "id_overlay",
    lambda s, f: id_overlay(_orders(s, f), allow=[_rich(s, f)], deny=_segment(s, f, "MACHINERY"), query_allow=_segment(s, f, "BUILDING", "MACHINERY", "HOUSEHOLD"), query_deny=_segment(s, f, "HOUSEHOLD"), capacity=_capacity(s, f)),
    f"WITH {_ORD} SELECT id, pos, score FROM o WHERE {_IN} AND {_RICH} AND {_BUILD}",
)

_BITMAPS = {"rich": _rich, "auto": lambda s, f: _segment(s, f, "AUTOMOBILE", "MACHINERY"), "building": lambda s, f: _segment(s, f, "BUILDING")}
add(
    "id_bitmap_allow_deny",
    lambda s, f: idsets.id_pass(_orders(s, f), [idsets.build(_rich(s, f))], [idsets.build(_BITMAPS["auto"](s, f))]),
    f"WITH {_ORD} SELECT id, pos, score FROM o WHERE {_RICH} AND NOT {_AUTO}",
)
add(
    "id_bitmap_upkeep",
    lambda s, f: idsets.count(idsets.clear_ids(idsets.set_ids(idsets.build(_rich(s, f)), _BITMAPS["building"](s, f)), _BITMAPS["auto"](s, f).where("id % 2 = 0"))),
    "SELECT count(*) AS kept FROM customer WHERE (c_acctbal > 0 OR c_mktsegment = 'BUILDING') AND NOT (c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AND c_custkey % 2 = 0)",
)

# selection, dedup, reservoirs

add("topk_min", lambda s, f: topk.top_k(_orders(s, f), 100, "score", tie="pos").select("rank", "pos", "score"), f"WITH {_ORD} SELECT row_number() OVER (ORDER BY score, pos) AS rank, pos, score FROM o ORDER BY score, pos LIMIT 100")
add("topk_max", lambda s, f: topk.top_k(_orders(s, f), 100, "score", False, "pos").select("rank", "pos", "score"), f"WITH {_ORD} SELECT row_number() OVER (ORDER BY score DESC, pos) AS rank, pos, score FROM o ORDER BY score DESC, pos LIMIT 100")


def _merge(spark, sf):
    v = scaled(spark, sf)
    parts = [search.batch_knn(v.where(F.col("label") % 2 == side), probes(v), 8) for side in (0, 1)]
    return topk.merge_top_k(parts, 8).select("qid", "rank", "id", "distance")


add("topk_merge", _merge, f"WITH {S.SCALED}, {_PAIRS} SELECT qid, rank, id, distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 8")


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_type", F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("value").alias("score"))


_SEEN = "s AS (SELECT event_type, user_id AS id, event_id AS pos, value AS score FROM events)"
add("dedup_first_seen", lambda s, f: topk.first_seen(_seen(s, f)).select("id", "pos"), f"WITH {_SEEN} SELECT id, min(pos) AS pos FROM s GROUP BY id")
add("dedup_scores", lambda s, f: topk.first_seen(_seen(s, f), by=("event_type",)), f"WITH {_SEEN} SELECT event_type, id, pos, score FROM s QUALIFY row_number() OVER (PARTITION BY event_type, id ORDER BY pos) = 1")
add("dedup_mask", lambda s, f: topk.seen_mask(_seen(s, f), by=("event_type",)).select("pos", "mask"), f"WITH {_SEEN} SELECT pos, (row_number() OVER (PARTITION BY event_type, id ORDER BY pos) = 1)::BIGINT AS mask FROM s")
add("dedup_stats", lambda s, f: topk.seen_stats(_seen(s, f), by=("event_type",)), f"WITH {_SEEN} SELECT event_type, sum(n)::BIGINT AS total, count(*) AS \"unique\", (sum(n) - count(*))::BIGINT AS duplicates, (sum(n) - count(*))::DOUBLE / sum(n) AS rate FROM (SELECT event_type, id, count(*) AS n FROM s GROUP BY ALL) GROUP BY event_type")
add(
    "reservoir_topc",
    lambda s, f: topk.reservoir(_seen(s, f), 32, "event_type", pos="pos").select("event_type", "rank", "id", "score"),
    f"WITH {_SEEN}, u AS (SELECT * FROM s WHERE isfinite(score) QUALIFY row_number() OVER (PARTITION BY event_type, id ORDER BY pos) = 1) SELECT event_type, rank, id, score FROM {S.ranked('u', 'score, id', 'event_type')} WHERE rank <= 32",
)

# norms, transforms, codecs

add("vector_norms", lambda s, f: transform.norms(scaled(s, f)), f"WITH {S.SCALED} SELECT id, {S.dot('v', 'v')} AS norm_sq, 1.0::DOUBLE / sqrt(greatest({S.dot('v', 'v')}, 1e-12)) AS inv_norm FROM emb")
_RADIUS = f"r AS (SELECT max({S.dot('v', 'v')}) * (1 + 1e-6::DOUBLE) AS r2 FROM emb)"
add(
    "mips_augment",
    lambda s, f: transform.mips_augment(v := scaled(s, f), transform.mips_radius(v)).select("id", F.size("vector").cast("long").alias("d"), F.element_at("vector", -1).alias("extra")),
    f"WITH {S.SCALED}, {_RADIUS} SELECT id, 65::BIGINT AS d, sqrt(greatest(0.0::DOUBLE, r2 - {S.dot('v', 'v')})) AS extra FROM emb, r",
)
add(
    "mips_scores",
    lambda s, f: transform.mips_scores(v := scaled(s, f), probes(v), transform.mips_radius(v)),
    f"WITH {S.SCALED}, {_RADIUS} SELECT q.id AS qid, e.id, {S.dot('q.v', 'q.v')} + r2 - {S.dot('q.v', 'e.v')} * 2 AS score FROM emb q, emb e, r WHERE q.id % 20 = 0",
)


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.select("id", F.array_join(F.col(column).cast("array<string>"), ",").alias(column))


_Q8 = "list_transform(v, lambda x: greatest(-128, least(127, round_even(x * (1 / 0.05::DOUBLE), 0)::INTEGER)))"
add("quantize_i8", lambda s, f: _joined(scaled(s, f).select("id", codecs.quantize_symmetric(F.col("vector"), 0.05).alias("code")), "code"), f"WITH {S.SCALED} SELECT id, array_to_string({_Q8}, ',') AS code FROM emb")
add(
    "dequantize_i8",
    lambda s, f: scaled(s, f).select("id", F.posexplode(codecs.dequantize_symmetric(codecs.quantize_symmetric(F.col("vector"), 0.05), 0.05)).alias("at", "x")),
    f"WITH {S.SCALED}, c AS (SELECT id, {_Q8} AS code FROM emb) SELECT id, (i - 1)::BIGINT AS at, code[i]::DOUBLE * 0.05::DOUBLE AS x FROM c, (SELECT unnest(range(1, 65)) AS i)",
)
_NIB = "list_transform(v, lambda x: (round_even(x * 16, 0)::INTEGER & 15))"
add("u4_pack", lambda s, f: _joined(scaled(s, f).select("id", codecs.pack_nibbles(_nibbles()).alias("packed")), "packed"), f"WITH {S.SCALED}, n AS (SELECT id, {_NIB} AS c FROM emb) SELECT id, array_to_string(list_transform(range(0, 32), lambda p: c[2 * p + 1] | (c[2 * p + 2] << 4)), ',') AS packed FROM n")
add("u4_unpack", lambda s, f: _joined(scaled(s, f).select("id", codecs.unpack_nibbles(codecs.pack_nibbles(_nibbles())).alias("codes")), "codes"), f"WITH {S.SCALED} SELECT id, array_to_string({_NIB}, ',') AS codes FROM emb")
add(
    "layout_roundtrip",
    lambda s, f: transform.deinterleave(transform.interleave(scaled(s, f), 8)).select("id", F.posexplode("vector").alias("at", "x")),
    f"WITH {S.SCALED} SELECT id, (i - 1)::BIGINT AS at, v[i] AS x FROM emb, (SELECT unnest(range(1, 65)) AS i)",
)


def _nibbles():
    return F.transform("vector", lambda x: F.rint(x * 16).cast("int").bitwiseAND(15))


# inverted lists with fixed centroids

_NEAR = "near AS (SELECT e.id, c.list_id, {dist} AS distance FROM emb e, cen c)"
_ASSIGN = "asg AS (SELECT id, list_id, distance FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, list_id) = 1)"
_LISTS = f"WITH {S.SCALED}, {S.CENTROIDS}, {_NEAR.format(dist=S.distance('euclidean', 'e.v', 'c.c'))}, {_ASSIGN}"
_COSINE_LISTS = f"WITH {S.SCALED}, {S.CENTROIDS}, {_NEAR.format(dist=S.distance('cosine', 'e.v', 'c.c'))}, {_ASSIGN}"
add("ivf_assign_l2", lambda s, f: kmeans.assign(v := scaled(s, f), centroids(v)), f"{_LISTS} SELECT id, list_id, distance FROM asg")
add("ivf_assign_cosine", lambda s, f: kmeans.assign(v := scaled(s, f), centroids(v), "cosine"), f"{_COSINE_LISTS} SELECT id, list_id, distance FROM asg")
add(
    "ivf_build_arrow",
    lambda s, f: ivf.build(v := scaled(s, f), centroids(v)).select("id", "list_id"),
    f"{_LISTS} SELECT id, list_id FROM asg",
)
add("kmeans_assign", lambda s, f: kmeans.assign(v := plain(s, f), centroids(v)), _LISTS.replace(S.SCALED, S.PLAIN) + " SELECT id, list_id, distance FROM asg")
add("kmeans_cost", lambda s, f: kmeans.cost(v := scaled(s, f), centroids(v)).select("n", F.round("cost", 6).alias("cost")), f"{_LISTS} SELECT count(*) AS n, round(sum(distance * distance), 6) AS cost FROM asg")
add(
    "kmeans_lloyd_step",
    lambda s, f: kmeans.lloyd_step(v := scaled(s, f), centroids(v)).select("list_id", "n", F.posexplode("centroid").alias("at", "x")).select("list_id", "n", "at", F.round("x", 9).alias("x")),
    f"{_LISTS} SELECT a.list_id, count(*) AS n, (i - 1)::BIGINT AS at, round(avg(e.v[i]), 9) AS x FROM asg a JOIN emb e USING (id), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.list_id, i",
)
add("ivf_list_stats", lambda s, f: ivf.list_stats(ivf.build(v := scaled(s, f), centroids(v)), centroids(v)), f"{_LISTS} SELECT c.list_id, count(a.id) AS length FROM cen c LEFT JOIN asg a USING (list_id) GROUP BY c.list_id")


def _select_sql(metric: str, extra: str = "") -> str:
    direction = "" if metric == "euclidean" else " DESC"
    return f"WITH {S.SCALED}, {S.CENTROIDS}, d AS (SELECT q.id AS qid, c.list_id, {S.score(metric, 'q.v', 'c.c')} AS score FROM emb q, cen c {extra}) SELECT qid, rank, list_id, score FROM {S.ranked('d', f'score{direction}, list_id')} WHERE rank <= 4"


def _all_queries(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("qid"), F.col("vector").alias("q"))


for short, metric in (("l2", "euclidean"), ("ip", "dot"), ("cosine", "cosine")):
    add(f"ivf_select_{short}", lambda s, f, metric=metric: ivf.select_lists(centroids(v := scaled(s, f)), probes(v), 4, metric), _select_sql(metric, "WHERE q.id % 20 = 0"))
add("ivf_select_batch", lambda s, f: ivf.select_lists(centroids(v := scaled(s, f)), _all_queries(v), 4), _select_sql("euclidean"))
add("ivf_select_beam", lambda s, f: ivf.select_beam(centroids(v := scaled(s, f)), _all_queries(v), 4, 8), _select_sql("euclidean"))
add("ivf_select_disabled", lambda s, f: ivf.select_lists(centroids(v := scaled(s, f)), _all_queries(v), 4, disabled=[0, 3, 7]), _select_sql("euclidean", "WHERE c.list_id NOT IN (0, 3, 7)"))
_PROBED = f"pr AS (SELECT qid, list_id FROM (SELECT q.id AS qid, c.list_id, row_number() OVER (PARTITION BY q.id ORDER BY {S.distance('euclidean', 'q.v', 'c.c')}, c.list_id) AS n FROM emb q, cen c WHERE q.id % 20 = 0) WHERE n <= 3)"
_HITS = f"d AS (SELECT pr.qid, e.id, {_L2} AS distance FROM pr JOIN asg USING (list_id) JOIN emb e ON e.id = asg.id JOIN emb q ON q.id = pr.qid {{where}})"
for name, where, condition in (("ivf_search_l2", None, ""), ("ivf_search_filtered", "label < 5", "WHERE e.label < 5")):
    add(
        name,
        lambda s, f, where=where: ivf.search(ivf.build(v := scaled(s, f), centroids(v)), centroids(v), probes(v), 10, 3, where=None if where is None else F.expr(where)),
        f"{_LISTS}, {_PROBED}, {_HITS.format(where=condition)} SELECT qid, rank, id, distance FROM {S.ranked('d', 'distance, id')} WHERE rank <= 10",
    )
add("residual_norms", lambda s, f: _residuals(s, f).select("id", "list_id", metrics.norm_squared(F.col("residual"), 64).alias("norm_sq")), f"{_LISTS} SELECT a.id, a.list_id, {S.l2sq('e.v', 'c.c')} AS norm_sq FROM asg a JOIN emb e USING (id) JOIN cen c USING (list_id)")
add("residuals", lambda s, f: _residuals(s, f).select("id", "list_id", F.posexplode("residual").alias("at", "x")), f"{_LISTS} SELECT a.id, a.list_id, (i - 1)::BIGINT AS at, e.v[i] - c.c[i] AS x FROM asg a JOIN emb e USING (id) JOIN cen c USING (list_id), (SELECT unnest(range(1, 65)) AS i)")


def _residuals(spark, sf):
    v = scaled(spark, sf)
    return transform.residuals(ivf.build(v, centroids(v)), centroids(v))


def _list_rows(spark, sf):
    v = scaled(spark, sf)
    lists = stored(ivf.build(v, centroids(v)).select("list_id", F.col("id").alias("external_id")), "placed")
    none = lists.where("false").select("list_id", F.lit(0).cast("long").alias("pos"), "external_id")
    even = ivf.append(none, lists.where("external_id % 2 = 0").withColumn("seq", F.col("external_id")))
    return ivf.append(even, lists.where("external_id % 2 = 1").withColumn("seq", F.col("external_id")))


add("ivf_append", _list_rows, f"{_LISTS} SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY id % 2, id) - 1 AS pos, id AS external_id FROM asg")
add(
    "ivf_insert_at",
    lambda s, f: ivf.insert_at(_list_rows(s, f), 0, 1, s.createDataFrame([(0, -1), (1, -2)], "seq int, external_id long")),
    f"{_LISTS}, l AS (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY id % 2, id) - 1 AS pos, id AS external_id FROM asg) SELECT list_id, CASE WHEN list_id = 0 AND pos >= 1 THEN pos + 2 ELSE pos END AS pos, external_id FROM l UNION ALL SELECT 0, 1, -1 UNION ALL SELECT 0, 2, -2",
)

# product quantization with fixed codebooks

_PARTS = "parts AS (SELECT id, s AS sub, v[s * 8 + 1 : s * 8 + 8] AS p FROM emb, (SELECT unnest(range(0, 8)) AS s))"
_BOOK = "book AS (SELECT sub, id // 20 AS code, p AS c FROM parts WHERE id % 20 = 0 {cut})"
_CODES = f"codes AS (SELECT p.id, p.sub, b.code, {S.l2sq('p.p', 'b.c', 8)} AS error FROM parts p JOIN book b USING (sub) QUALIFY row_number() OVER (PARTITION BY p.id, p.sub ORDER BY error, b.code) = 1)"
_PQ = f"WITH {S.SCALED}, {_PARTS}, {_BOOK.format(cut='')}, {_CODES}"
_PQ4 = f"WITH {S.SCALED}, {_PARTS}, {_BOOK.format(cut='AND id < 320')}, {_CODES}"
_LUT = f"lut AS (SELECT q.id AS qid, q.sub, b.code, {S.l2sq('q.p', 'b.c', 8)} AS d FROM parts q JOIN book b USING (sub) WHERE q.id % 20 = 0)"
_ADC = f"adc AS (SELECT qid, id, list_sum(list(d ORDER BY sub)) AS distance FROM (SELECT l.qid, c.id, c.sub, l.d FROM codes c JOIN lut l ON l.sub = c.sub AND l.code = c.code) GROUP BY qid, id)"


def _adc(spark, sf, within=None):
    v = scaled(spark, sf)
    return pq.adc_scan(pq.encode_in_place(v, codebooks(v), M), probes(v), codebooks(v), within=within)


add("pq_encode", lambda s, f: pq.encode(v := scaled(s, f), codebooks(v), M), f"{_PQ} SELECT id, sub, code, error FROM codes")
add(
    "pq_encode_u4",
    lambda s, f: _joined(pq.encode_in_place(v := scaled(s, f), codebooks(v, 16), M).select("id", codecs.pack_nibbles(F.col("codes")).alias("packed")), "packed"),
    f"{_PQ4}, a AS (SELECT id, list(code ORDER BY sub) AS c FROM codes GROUP BY id) SELECT id, array_to_string(list_transform(range(0, 4), lambda p: c[2 * p + 1] | (c[2 * p + 2] << 4)), ',') AS packed FROM a",
)
_RES_PARTS = "parts AS (SELECT r.id, s AS sub, r.v[s * 8 + 1 : s * 8 + 8] AS p FROM (SELECT a.id, list_transform(range(1, 65), lambda i: e.v[i] - c.c[i]) AS v FROM asg a JOIN emb e USING (id) JOIN cen c USING (list_id)) r, (SELECT unnest(range(0, 8)) AS s)), raw AS (SELECT id, s AS sub, v[s * 8 + 1 : s * 8 + 8] AS p FROM emb, (SELECT unnest(range(0, 8)) AS s)), book AS (SELECT sub, id // 20 AS code, p AS c FROM raw WHERE id % 20 = 0)"
add("pq_encode_residual", lambda s, f: pq.encode_residual(ivf.build(v := scaled(s, f), centroids(v)), centroids(v), codebooks(v), M), f"{_LISTS}, {_RES_PARTS}, {_CODES} SELECT id, sub, code, error FROM codes")
add(
    "pq_lloyd_round",
    lambda s, f: pq.train_all(v := scaled(s, f), M, codebooks(v).count() // M, rounds=1, empty="ignore", start=codebooks(v))[0].select("sub", "code", F.posexplode("centroid").alias("at", "x")).select("sub", "code", "at", F.round("x", 9).alias("x")),
    f"{_PQ}, m AS (SELECT c.sub, c.code, i, avg(p.p[i]) AS x FROM codes c JOIN parts p USING (id, sub), (SELECT unnest(range(1, 9)) AS i) GROUP BY c.sub, c.code, i) SELECT b.sub, b.code, (i - 1)::BIGINT AS at, round(coalesce(m.x, b.c[i]), 9) AS x FROM (SELECT *, unnest(range(1, 9)) AS i FROM book) b LEFT JOIN m USING (sub, code, i)",
)
add("pq_distortion", lambda s, f: pq.distortion(pq.encode(v := scaled(s, f), codebooks(v), M)).select(F.round("distortion", 9).alias("distortion")), f"{_PQ} SELECT round(sum(e), 9) AS distortion FROM (SELECT avg(error) AS e FROM codes GROUP BY sub)")
add("pq_subnorms", lambda s, f: pq.sub_norms(probes(scaled(s, f)), M), f"WITH {S.SCALED}, {_PARTS} SELECT id AS qid, sub, {S.dot('p', 'p', 8)} AS norm_sq FROM parts WHERE id % 20 = 0")
add("pq_lut", lambda s, f: pq.lookup_tables(probes(v := scaled(s, f)), codebooks(v), M), f"{_PQ}, {_LUT} SELECT qid, sub, code, d FROM lut")
add(
    "pq_lut_residual",
    lambda s, f: pq.residual_lookup_tables(probes(v := scaled(s, f)), ivf.select_lists(centroids(v), probes(v), 2).select("qid", "list_id"), centroids(v), codebooks(v), M),
    f"WITH {S.SCALED}, {S.CENTROIDS}, {_PROBED.replace('n <= 3', 'n <= 2')}, {_PARTS}, {_BOOK.format(cut='')}, rest AS (SELECT pr.qid, pr.list_id, list_transform(range(1, 65), lambda i: q.v[i] - c.c[i]) AS v FROM pr JOIN emb q ON q.id = pr.qid JOIN cen c USING (list_id)), rp AS (SELECT qid, list_id, s AS sub, v[s * 8 + 1 : s * 8 + 8] AS p FROM rest, (SELECT unnest(range(0, 8)) AS s)) SELECT qid, list_id, sub, code, {S.l2sq('rp.p', 'b.c', 8)} AS d FROM rp JOIN book b USING (sub)",
)
add("adc_scan", _adc, f"{_PQ}, {_LUT}, {_ADC} SELECT qid, id, distance FROM adc")
add("pq_range", lambda s, f: _adc(s, f, 20.0), f"{_PQ}, {_LUT}, {_ADC} SELECT qid, id, distance FROM adc WHERE distance <= 20")


def _pq_rerank(spark, sf):
    v = scaled(spark, sf)
    codes = pq.encode_in_place(v, codebooks(v), M).select("id", "codes")
    return search.rerank_top_k(pq.nearest_codes(codes, probes(v), codebooks(v), 40).select("qid", "id"), v, probes(v), 10)


add("pq_rerank", _pq_rerank, f"{_PQ}, {_LUT}, {_ADC}, can AS (SELECT qid, id FROM {S.ranked('adc', 'distance, id')} WHERE rank <= 40), {_rerank_sql('euclidean').replace('can.pos, ', '')} SELECT qid, rank, id, score FROM {S.ranked('sc', 'score, id')} WHERE rank <= 10")

# ids and the collection

add("id_assign", lambda s, f: ids.assign_ids(_read(s, f, "customer").select(F.col("c_name").alias("external_id"))), "SELECT c_name AS external_id, row_number() OVER (ORDER BY c_name) - 1 AS internal_id FROM customer")


def _remap(spark, sf):
    known = ids.assign_ids(_read(spark, sf, "customer").select(F.col("c_name").alias("external_id")), first=1)
    return ids.remap(_read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 30).alias("internal_id")), known)


add("id_remap", _remap, "WITH k AS (SELECT c_name AS e, row_number() OVER (ORDER BY c_name) AS i FROM customer) SELECT o_orderkey, o_custkey + 30 AS internal_id, coalesce(e, (o_custkey + 30)::VARCHAR) AS name FROM orders LEFT JOIN k ON i = o_custkey + 30")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """All events as operations on users: mostly upserts, some removals and updates of one field, one clear."""
    e = _read(spark, sf, "events")
    n = F.col("event_id")
    op = F.when(n == 500, "clear").when(n % 9 == 0, "remove").when(n % 3 == 1, "update").otherwise("upsert")
    vector = F.when((n % 9 != 0) & ((n % 3 != 1) | (n % 2 == 0)), F.array(F.col("value").cast("float")))
    metadata = F.when((n % 9 != 0) & ((n % 3 != 1) | (n % 2 == 1)), F.create_map(F.lit("type"), F.col("event_type")))
    return e.select(n.alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), vector.alias("vector"), metadata.alias("metadata"))


_LOG = "lg AS (SELECT event_id AS seq, CASE WHEN event_id = 500 THEN 'clear' WHEN event_id % 9 = 0 THEN 'remove' WHEN event_id % 3 = 1 THEN 'update' ELSE 'upsert' END AS op, user_id::VARCHAR AS id, CASE WHEN event_id % 9 <> 0 AND (event_id % 3 <> 1 OR event_id % 2 = 0) THEN value::FLOAT END AS v, CASE WHEN event_id % 9 <> 0 AND (event_id % 3 <> 1 OR event_id % 2 = 1) THEN event_type END AS t FROM events), li AS (SELECT * FROM lg WHERE seq > coalesce((SELECT max(seq) FROM lg WHERE op = 'clear'), -2) AND op <> 'clear')"
_LIVE = "w AS (SELECT id, max(seq) AS at FROM li WHERE op IN ('upsert', 'remove') GROUP BY id), b AS (SELECT li.id, li.seq AS at, li.v, li.t FROM w JOIN li ON li.id = w.id AND li.seq = w.at WHERE li.op = 'upsert')"
add(
    "collection_live_view",
    lambda s, f: live_view(None, _log(s, f).where("op <> 'update'")).select("id", F.get("vector", F.lit(0)).cast("double").alias("x"), F.try_element_at("metadata", F.lit("type")).alias("type")),
    f"WITH {_LOG}, {_LIVE} SELECT id, v::DOUBLE AS x, t AS type FROM b",
)
add(
    "collection_update_nulls",
    lambda s, f: live_view(None, _log(s, f)).select("id", F.get("vector", F.lit(0)).cast("double").alias("x"), F.try_element_at("metadata", F.lit("type")).alias("type")),
    f"WITH {_LOG}, {_LIVE} SELECT b.id, coalesce(arg_max(li.v, li.seq) FILTER (li.op = 'update' AND li.seq > b.at AND li.v IS NOT NULL), any_value(b.v))::DOUBLE AS x, coalesce(arg_max(li.t, li.seq) FILTER (li.op = 'update' AND li.seq > b.at AND li.t IS NOT NULL), any_value(b.t)) AS type FROM b JOIN li USING (id) GROUP BY b.id, b.at",
)

# ranges with id sets and a reservoir, stored lists, packed scans, caches and counters


def _range_sets(spark, sf):
    v = scaled(spark, sf)
    return search.range_search(v, probes(v), 6.0, allow=[v.where("label < 7").select("id")], deny=[v.where("id % 3 = 0").select("id")], first_seen=True, reservoir=5)


add(
    "range_filtered_reservoir",
    _range_sets,
    f"WITH {S.SCALED}, d AS (SELECT q.id AS qid, e.id, {_L2} AS score FROM emb q, emb e WHERE q.id % 20 = 0 AND e.label < 7 AND e.id % 3 <> 0), i AS (SELECT * FROM d WHERE score <= 6.0) SELECT qid, id, score FROM {S.ranked('i', 'score, id')} WHERE rank <= 5",
)


def _store(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A list store of all vectors: those with even ids first, then the others."""
    v = scaled(spark, sf)
    # a list's end, and each part of the rows, would place and encode all rows again
    coded = stored(pq.encode_in_place(ivf.build(v, centroids(v)), codebooks(v, 16), M).select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "codes"), "coded")
    store = lists.ingest(lists.empty(spark), coded.where("external_id % 2 = 0"), kind)
    return lists.ingest(store, coded.where("external_id % 2 = 1"), kind)


_STORED = f"{_LISTS}, {_PARTS}, {_BOOK.format(cut='AND id < 320')}, {_CODES}, a AS (SELECT id, list(code ORDER BY sub) AS c FROM codes GROUP BY id), st AS (SELECT asg.list_id, row_number() OVER (PARTITION BY asg.list_id ORDER BY id % 2, id) - 1 AS pos, id AS external_id, c FROM asg JOIN a USING (id))"
add(
    "list_ingest_pq8",
    lambda s, f: _store(s, f, "pq8").select("list_id", "pos", "external_id", F.hex("payload").alias("payload")),
    f"{_STORED} SELECT list_id, pos, external_id, array_to_string(list_transform(c, lambda x: printf('%02X', x)), '') AS payload FROM st",
)
add(
    "list_ingest_pq4",
    lambda s, f: _store(s, f, "pq4").select("list_id", "pos", "external_id", F.hex("payload").alias("payload")),
    f"{_STORED} SELECT list_id, pos, external_id, array_to_string(list_transform(range(0, 4), lambda p: printf('%02X', c[2 * p + 1] | (c[2 * p + 2] << 4))), '') AS payload FROM st",
)
add(
    "list_read",
    lambda s, f: lists.read_list(_store(s, f, "pq4"), 3, "pq4", M).select("pos", "external_id", F.array_join(F.col("content").cast("array<string>"), ",").alias("codes")),
    f"{_STORED} SELECT pos, external_id, array_to_string(c, ',') AS codes FROM st WHERE list_id = 3",
)
add("list_bytes", lambda s, f: lists.statistics(_store(s, f, "pq4"), centroids(scaled(s, f))), f"{_STORED} SELECT cen.list_id, count(st.pos) AS length, count(st.pos) * 4 AS bytes FROM cen LEFT JOIN st USING (list_id) GROUP BY cen.list_id")


def _adc_u4(spark, sf):
    v = scaled(spark, sf)
    packed = _store(spark, sf, "pq4").select(F.col("external_id").alias("id"), lists.unpack("pq4", F.col("payload"), M).alias("codes"))
    return pq.adc_scan(packed, probes(v), codebooks(v, 16), bias=1.5)


def _list_search(kind):
    def run(spark, sf):
        v = scaled(spark, sf)
        if kind in lists.VECTORS:
            rows = stored(ivf.build(v, centroids(v)).select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector"), "placed")
            store, books = lists.ingest(lists.empty(spark), rows, kind, "vector"), None
        else:
            store, books = _store(spark, sf, kind), codebooks(v, 16)
        names = v.select(F.col("id").alias("internal_id"), (F.col("id") + 1000000).alias("external_id"))
        return lists.search(store, kind, centroids(v), probes(v), 10, 3, "euclidean", books, names)

    return run


_FLAT32 = _LISTS.replace(S.SCALED, S.SCALED + ", low AS (SELECT id, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v FROM emb)")
add(
    "list_search_flat",
    _list_search("flat"),
    f"{_FLAT32}, {_PROBED}, d AS (SELECT pr.qid, e.id, {S.l2sq('q.v', 'e.v')} AS score FROM pr JOIN asg USING (list_id) JOIN low e ON e.id = asg.id JOIN emb q ON q.id = pr.qid) SELECT qid, rank, id + 1000000 AS id, score FROM {S.ranked('d', 'score, id')} WHERE rank <= 10",
)
_E = "greatest(-14, floor(log2(abs(x))))"
_HALF = f"(CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x * pow(2.0::DOUBLE, 10 - {_E}), 0) * pow(2.0::DOUBLE, {_E} - 10) END)"
_HALVES = _LISTS.replace(S.SCALED, S.SCALED + f", low AS (SELECT id, list_transform(list_transform(v, lambda x: x::FLOAT::DOUBLE), lambda x: {_HALF}) AS v FROM emb)")
add(
    "list_search_half",
    _list_search("half"),
    f"{_HALVES}, {_PROBED}, d AS (SELECT pr.qid, e.id, {S.l2sq('q.v', 'e.v')} AS score FROM pr JOIN asg USING (list_id) JOIN low e ON e.id = asg.id JOIN emb q ON q.id = pr.qid) SELECT qid, rank, id + 1000000 AS id, score FROM {S.ranked('d', 'score, id')} WHERE rank <= 10",
)
_HALF_BITS = f"((CASE WHEN x < 0 THEN -32768 ELSE 0 END) + CASE WHEN x = 0 THEN 0 ELSE ({_E} + 14) * 1024 + round_even(abs(x) * pow(2.0::DOUBLE, 10 - {_E}), 0) END)::INTEGER"
add(
    "half_bits",
    lambda s, f: _joined(scaled(s, f).select("id", F.transform("vector", codecs.half_bits).alias("bits")), "bits"),
    f"WITH {S.SCALED} SELECT id, array_to_string(list_transform(v, lambda x: {_HALF_BITS}), ',') AS bits FROM emb",
)


def _reader(spark, sf):
    """Candidates that name their lists, re-ranked by the vectors in a list store."""
    v = scaled(spark, sf)
    placed = stored(ivf.build(v, centroids(v)), "placed")
    store = lists.ingest(lists.empty(spark), placed.select("list_id", F.col("id").alias("external_id"), F.col("id").alias("seq"), "vector"), "flat", "vector")
    named = _candidates(v).join(placed.select("id", "list_id"), "id", "left")
    return search.rerank_top_k(named, readers.ListReader(store), probes(v), 5)


add(
    "rerank_list_reader",
    _reader,
    f"{_FLAT32}, {_CAND}, sc AS (SELECT can.qid, can.id, {S.l2sq('q.v', 'e.v')} AS score FROM can JOIN emb q ON q.id = can.qid JOIN low e ON e.id = can.id) SELECT qid, rank, id, score FROM {S.ranked('sc', 'score, id')} WHERE rank <= 5",
)
for kind in ("pq8", "pq4"):
    add(
        f"list_search_{kind}",
        _list_search(kind),
        f"{_LISTS}, {_PROBED}, {_PARTS}, {_BOOK.format(cut='AND id < 320')}, {_CODES}, {_LUT}, {_ADC}, d AS (SELECT qid, id, adc.distance AS score FROM pr JOIN asg USING (list_id) JOIN adc USING (qid, id)) SELECT qid, rank, id + 1000000 AS id, score FROM {S.ranked('d', 'score, id')} WHERE rank <= 10",
    )
add("adc_scan_u4", _adc_u4, f"{_PQ4}, {_LUT}, {_ADC} SELECT qid, id, distance + 1.5 AS distance FROM adc")
_AFFINE = "list_transform(v, lambda x: greatest(-128, least(127, round_even(x * (1 / 0.1::DOUBLE), 0)::INTEGER + 7)))"
add("quantize_affine", lambda s, f: _joined(scaled(s, f).select("id", codecs.quantize_affine(F.col("vector"), 0.1, 7).alias("code")), "code"), f"WITH {S.SCALED} SELECT id, array_to_string({_AFFINE}, ',') AS code FROM emb")
add(
    "norm_cache_update",
    lambda s, f: transform.update_norms(transform.norms(plain(s, f)), scaled(s, f).where("id % 4 = 1")),
    f"WITH {S.SCALED}, p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT id, v FROM emb WHERE id % 4 = 1 UNION ALL SELECT id, v FROM p WHERE id % 4 <> 1) SELECT id, {S.dot('v', 'v')} AS norm_sq, 1.0::DOUBLE / sqrt(greatest({S.dot('v', 'v')}, 1e-12)) AS inv_norm FROM m",
)
_INVERSE = "(1.0::DOUBLE / sqrt(greatest({0}, 1e-12)))"
add(
    "cosine_stored_norms",
    lambda s, f: transform.cosine_with_norms(v := scaled(s, f), transform.norms(v), probes(v)),
    f"WITH {S.SCALED} SELECT q.id AS qid, e.id, {S.dot('q.v', 'e.v')} * {_INVERSE.format(S.dot('q.v', 'q.v'))} * {_INVERSE.format(S.dot('e.v', 'e.v'))} AS score FROM emb q, emb e WHERE q.id % 20 = 0",
)
_HALF_INVERSE = f"list_transform([{_INVERSE.format(S.dot('v', 'v'))}], lambda x: {_HALF})[1]"
add(
    "cosine_half_norms",
    lambda s, f: transform.nearest_with_norms(transform.with_norms(v := scaled(s, f), half=True), probes(v), 10),
    f"WITH {S.SCALED}, h AS (SELECT id, v, {_HALF_INVERSE} AS i FROM emb), d AS (SELECT q.id AS qid, e.id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {S.dot('q.v', 'e.v')} * {_INVERSE.format(S.dot('q.v', 'q.v'))} * e.i)) AS score FROM emb q, h e WHERE q.id % 20 = 0) SELECT qid, rank, id, score FROM {S.ranked('d', 'score DESC, id')} WHERE rank <= 10",
)


def _hinted(spark, sf):
    """Two thirds of the rows bring their squared norms along."""
    v = scaled(spark, sf)
    with_norms = v.withColumn("norm_sq", F.when(F.col("id") % 3 != 0, metrics.norm_squared(F.col("vector"), S.D)))
    return search.batch_knn(with_norms, probes(v), 10, "cosine", norms="norm_sq")


add("batch_knn_norm_hint", _hinted, ORACLES["batch_knn_cosine"])
add(
    "reservoir_counters",
    lambda s, f: topk.reservoir_counters(_seen(s, f), 32, "event_type"),
    f"WITH {_SEEN} SELECT event_type, count(*) AS offered, count(*) FILTER (isfinite(score)) AS finite, count(DISTINCT id) FILTER (isfinite(score)) AS \"distinct\", least(count(DISTINCT id) FILTER (isfinite(score)), 32) AS kept, greatest(count(DISTINCT id) FILTER (isfinite(score)) - 32, 0) AS rejected FROM s GROUP BY event_type",
)


def _telemetry(spark, sf):
    """What searches count while they run: one of lists, one that counts a range."""
    v, told = scaled(spark, sf), Telemetry(spark)
    ivf.search(ivf.build(v, centroids(v)), centroids(v), probes(v), 10, 3, telemetry=told).write.format("noop").mode("overwrite").save()
    search.range_count(v, probes(v), 6.0, telemetry=told).write.format("noop").mode("overwrite").save()
    return told.row().select("rows_scored", "range_scored", "range_skipped", "found")


_NEAR_NORM = f"abs(sqrt({S.dot('q.v', 'q.v')}) - sqrt({S.dot('e.v', 'e.v')})) <= 6.0 * (1 + 1e-9) + 1e-9"
add(
    "search_telemetry",
    _telemetry,
    f"{_LISTS}, {_PROBED}, band AS (SELECT count(*) FILTER ({_NEAR_NORM}) AS n, count(*) AS total, count(*) FILTER (sqrt({S.l2sq('q.v', 'e.v')}) <= 6.0) AS found FROM emb q, emb e WHERE q.id % 20 = 0) SELECT (SELECT count(*) FROM pr JOIN asg USING (list_id)) AS rows_scored, n AS range_scored, total - n AS range_skipped, found FROM band",
)


def _sketched(spark, sf):
    """Customers by name, of which a part is known."""
    names = _read(spark, sf, "customer").select(F.col("c_name").alias("external_id"), "c_acctbal")
    known = ids.assign_ids(names.where("c_acctbal > 3000").select("external_id"))
    return ids.lookup_sketched(names, known).select("external_id", "internal_id")


add(
    "id_lookup_sketched",
    _sketched,
    "WITH k AS (SELECT c_name AS e, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer WHERE c_acctbal > 3000) SELECT c_name AS external_id, coalesce(i, -1) AS internal_id FROM customer LEFT JOIN k ON e = c_name",
)


def _get_or_create(spark, sf):
    names = _read(spark, sf, "customer").select(F.col("c_name").alias("external_id"), "c_acctbal")
    return ids.get_or_create(ids.assign_ids(names.where("c_acctbal > 0")), names.where("c_acctbal < 5000"))


add(
    "id_get_or_create",
    _get_or_create,
    "WITH k AS (SELECT c_name AS e, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer WHERE c_acctbal > 0), n AS (SELECT c_name AS e, row_number() OVER (ORDER BY c_name) - 1 + (SELECT count(*) FROM k) AS i FROM customer WHERE c_acctbal <= 0) SELECT e AS external_id, i AS internal_id FROM (SELECT * FROM k UNION ALL SELECT * FROM n) WHERE e IN (SELECT c_name FROM customer WHERE c_acctbal < 5000)",
)
add("id_permutation", lambda s, f: sampling.permutation(_read(s, f, "customer").select(F.col("c_custkey").alias("id")), 5), "SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('5:' || c_custkey::VARCHAR), c_custkey) - 1 AS position FROM customer")

# models that are trained or built: approximate neighbours; the tests hold their recall against exact search


def _hnsw(spark, sf):
    v = plain(spark, sf)
    s = hnsw.Settings(16, 100, 64, 42)
    return hnsw.search(stored(hnsw.build(v, "euclidean", s, 500), "graphs"), probes(v), 10, "euclidean", s, rows_per_shard=500)


def _updated(spark, sf) -> DurableGraph:
    """A stored graph: four fifths of the rows, then the others inserted, a tenth removed."""
    v = plain(spark, sf).select("id", "vector")
    g = DurableGraph.create(spark, fresh_path(spark, "graph"), v.where("id % 5 <> 0"), "euclidean", hnsw.Settings(16, 100, 64, 42), 500)
    g.insert(v.where("id % 5 = 0"))
    g.remove(v.where("id % 10 = 3").select("id"))
    return DurableGraph.open(spark, g.path)


def _replayed(spark, sf):
    g = _updated(spark, sf)
    g.insert(plain(spark, sf).where("id % 10 = 3").select("id", "vector"))
    return g.search(probes(plain(spark, sf)), 10)


def _compacted(spark, sf):
    g = _updated(spark, sf)
    g.compact()
    return g.search(probes(plain(spark, sf)), 10)


def _ivf_trained(spark, sf):
    v = plain(spark, sf)
    c = stored(ivf.train(v, 16), "centroids")
    return ivf.search(ivf.build(v, c), c, probes(v), 10, 12)


def _ivfpq(spark, sf):
    v = plain(spark, sf)
    c = stored(ivf.train(v, 16), "centroids")
    rest = stored(transform.residuals(ivf.build(v, c), c).select("id", "list_id", F.col("residual").alias("vector")), "residuals")
    books = stored(pq.train(rest, M, 128), "codebooks")
    codes = stored(pq.encode_in_place(rest, books, M).select("id", "list_id", "codes"), "codes")
    return pq.search(codes, c, books, v, probes(v), 10, 14, M, refine=20)


add("hnsw_knn", _hnsw)
add("hnsw_replayed_knn", _replayed)
add("hnsw_compacted_knn", _compacted)
add("hnsw_knn_graph", lambda spark, sf: hnsw.knn_graph(plain(spark, sf), 10, rows_per_shard=500))
add("ivf_trained_knn", _ivf_trained)
add("ivfpq_knn", _ivfpq)
