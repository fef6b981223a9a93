"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the
cores.  Each query runs once to warm up and once for its time, into a sink that keeps nothing.
``built`` holds the published configurations that build something: 5,000 vectors of 384 dimensions;
one graph in one task, and lists both trained and filled.  ``latency`` holds single searches (mean and
p95 seconds) and searches a second of batches, over ``embeddings``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINES = """knn_l2 batch_knn_l2 batch_knn_cosine batch_knn_dot batch_knn_arrow filtered_knn knn_graph_l2 range_l2 rerank_topk
filter_date_between filter_tags_any id_allow_deny topk_min topk_merge dedup_first_seen reservoir_topc ivf_assign_l2 ivf_select_batch
ivf_search_l2 ivf_trained_knn kmeans_lloyd_step pq_encode pq_lut adc_scan pq_rerank ivfpq_knn hnsw_knn hnsw_replayed_knn list_search_pq8 id_bitmap_allow_deny pq_lloyd_round residual_norms quantize_i8
id_remap collection_live_view""".split()


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from vectide.operators import hnsw, ivf, search
    from vectide.plans import catalogue
    from vectide.sources.generators import random_collection

    seconds = {}
    for name in HEADLINES:
        run = lambda: catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        seconds[name] = timed(run)

    base = random_collection(spark, 5_000, 384, partitions=int(cpus)).cache()
    queries = random_collection(spark, 200, 384, seed=321, partitions=1).select(F.col("id").alias("qid"), F.col("vector").alias("q")).cache()
    base.count(), queries.count()
    built: dict[str, float] = {}
    graphs, settings = [], hnsw.Settings(16, 200, 64)
    built["hnsw_build_one_graph_sec"] = timed(lambda: graphs.append(hnsw.build(base, "euclidean", settings, 5_000).cache()) or graphs[0].count())
    built["hnsw_build_in_shards_sec"] = timed(lambda: hnsw.build(base, "euclidean", settings, -(-5_000 // int(cpus))).write.format("noop").mode("overwrite").save())
    centroids: list = []
    built["ivf_train_sec"] = timed(lambda: centroids.append(ivf.train(base, 64)))
    lists = ivf.build(base, centroids[0]).cache()
    built["ivf_train_and_fill_sec"] = round(built["ivf_train_sec"] + timed(lists.count), 3)
    exact = search.batch_knn(base, queries, 10, strategy="arrow").select("qid", "id").cache()
    wanted = exact.count()
    share = lambda found: round(found.select("qid", "id").join(exact, ["qid", "id"]).count() / wanted, 4)
    built["hnsw_recall_at_10"] = share(hnsw.search(graphs[0], queries, 10, "euclidean", settings))
    built["ivf_recall_at_10_nprobe_16"] = share(ivf.search(lists, centroids[0], queries, 10, 16))
    latency: dict[str, float] = {}
    v = catalogue.plain(spark, sf).cache()
    few = [r.vector for r in v.where("id % 100 = 0").orderBy("id").limit(20).collect()]
    each = sorted(timed(lambda q=q: search.knn(v, q, 10).collect()) for q in few)
    latency["knn_mean_sec"], latency["knn_p95_sec"] = round(sum(each) / len(each), 4), each[min(len(each) - 1, int(0.95 * len(each)))]
    for name, run in (("flat", lambda: search.batch_knn(base, queries, 10)), ("ivf", lambda: ivf.search(lists, centroids[0], queries, 10, 16)), ("hnsw", lambda: hnsw.search(graphs[0], queries, 10, "euclidean", settings))):
        latency[f"{name}_batch_queries_a_sec"] = round(200 / timed(lambda run=run: run().count()), 1)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "built": built, "latency": latency, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
