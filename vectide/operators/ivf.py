"""Inverted lists: a coarse quantizer, probes, search within probed lists, list maintenance.

The lists are a table with ``list_id``; written with ``partitionBy("list_id")``, a search reads
only the probed lists, since the probes are broadcast and prune the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectide.functions import metrics
from vectide.operators import kmeans
from vectide.operators.nearest import Nearest
from vectide.operators.scan import blocks, scan
from vectide.operators.search import batch_knn, dimension_of, distances, matrix, spread
from vectide.operators.telemetry import Telemetry
from vectide.operators.topk import top_k_by
from vectide.operators.transform import CENTROID_BYTES
from vectide.schema import VectorError


def train(collection: DataFrame, nlist: int, seed: int = 42, **settings) -> DataFrame:
    """``(list_id, centroid)``; training is always Euclidean."""
    return kmeans.train(collection, nlist, seed, **settings)


def build(collection: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The collection with ``list_id``, added where the rows stand, without a shuffle."""
    return kmeans.assign_in_place(collection, centroids, metric).drop("distance")


def select_lists(centroids: DataFrame, queries: DataFrame, nprobe: int, metric: str = "euclidean", disabled: Sequence[int] = (), pad: bool = False) -> DataFrame:
    """``(qid, rank, list_id, score)`` of the best lists: squared distances ascending, or dot and cosine similarities descending; ties by list.

    ``pad`` fills up to nprobe rows a query with list -1 and no score.
    """
    if nprobe < 1:
        raise VectorError("invalid_k", "at least one list is probed", "select_lists", nprobe=nprobe)
    open_lists = centroids.where(~F.col("list_id").isin(list(disabled))) if disabled else centroids
    out = nearest_lists(open_lists, queries, nprobe, metric, raw=True)
    if pad:
        slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(nprobe))).alias("rank"))
        out = slots.join(out, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("list_id", F.lit(-1)).alias("list_id"), "score")
    return out


def select_beam(centroids: DataFrame, queries: DataFrame, nprobe: int, beam: int, graph: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """As ``select_lists``: a beam at least as wide as the probes, started from the exact best, cannot change them."""
    if beam < nprobe:
        raise VectorError("invalid_parameter", "a beam is at least as wide as the probes", "select_beam", beam=beam, nprobe=nprobe)
    return select_lists(centroids, queries, nprobe, metric)


def search(lists: DataFrame, centroids: DataFrame | None, queries: DataFrame, k: int, nprobe: int, metric: str = "euclidean", where: Column | None = None, telemetry: Telemetry | None = None) -> DataFrame:
    """``(qid, rank, id, distance)`` within the probed lists; the filter holds before the search.  Without centroids all rows are searched."""
    if centroids is None:
        return batch_knn(lists, queries, k, metric, where)
    rows = lists if where is None else lists.where(where)
    d = dimension_of(queries, "q")
    out = None
    for block in blocks(queries, d, lambda part: probes_of(centroids, part, nprobe, metric), nprobe):
        found = scan(rows, "vector", block, lambda c: matrix(c, d), lambda x, q, _, v=block.vectors: distances(v[q], x, metric), k, telemetry)
        best = top_k_by(found, k).select("qid", "rank", "id", "distance")
        out = best if out is None else out.unionByName(best)
    return out


def probes_of(centroids: DataFrame, block: DataFrame, nprobe: int, metric: str) -> DataFrame:
    """Probes by distance, which orders all five metrics."""
    return nearest_lists(centroids, block, nprobe, metric).select("qid", "list_id")


def nearest_lists(centroids: DataFrame, queries: DataFrame, nprobe: int, metric: str, raw: bool = False) -> DataFrame:
    """``(qid, rank, list_id, score)``: each query's best lists, where the query stands; ``raw`` orders by raw scores instead of distances.

    The model goes to the tasks in blocks of at most CENTROID_BYTES; only of several blocks are the bests shuffled.
    """
    d, n = dimension_of(centroids, "centroid"), centroids.count()
    parts = max(1, -(-n * (8 * d + 64) // CENTROID_BYTES))
    up = not raw or metrics.ascending(metric)
    asked = spread(queries.select("qid", "q"), n)
    schema = T.StructType([queries.schema["qid"], T.StructField("rank", T.IntegerType()), T.StructField("list_id", T.IntegerType()), T.StructField("score", T.DoubleType())])
    out = None
    for p in range(parts):
        block = centroids if parts == 1 else centroids.where(F.pmod(F.xxhash64("list_id"), F.lit(parts)) == p)
        table = block.select("list_id", "centroid").toArrow()
        lists = table.column(0).to_numpy().astype(np.int64)
        model = matrix(table.column(1).combine_chunks(), d) if len(lists) else np.empty((0, d))
        part = asked.mapInArrow(_nearest_lists(lists, model, d, nprobe, metric, raw, schema.names), schema)
        out = part if out is None else out.unionByName(part)
    if parts > 1:
        out = top_k_by(out.drop("rank"), nprobe, score="score", ascending=up, tie="list_id")
    return out.select("qid", "rank", "list_id", "score")


def _nearest_lists(lists: np.ndarray, model: np.ndarray, d: int, nprobe: int, metric: str, raw: bool, names: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            search = Nearest(matrix(batch.column(1), d), nprobe, metric, raw)
            search.add(model, lists)
            at, found, score = search.found()
            rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(rank, pa.int32()), pa.array(found, pa.int32()), pa.array(score)], names=names)

    return run


def list_stats(lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(list_id, length)`` of all lists, empty ones too."""
    counts = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("length"))
    return centroids.select("list_id").join(counts, "list_id", "left").select("list_id", F.coalesce("length", F.lit(0)).alias("length"))


def append(lists: DataFrame, new: DataFrame) -> DataFrame:
    """``lists(list_id, pos, external_id, ...)`` with new rows (in order of their ``seq``) behind each list's end."""
    ends = lists.groupBy("list_id").agg((F.max("pos") + 1).alias("_end"))
    order = F.row_number().over(Window.partitionBy("list_id").orderBy("seq")) - 1
    placed = new.withColumn("_o", order).join(ends, "list_id", "left")
    placed = placed.withColumn("pos", (F.coalesce("_end", F.lit(0)) + F.col("_o")).cast(lists.schema["pos"].dataType))
    return lists.unionByName(placed.select(*lists.columns))


def insert_at(lists: DataFrame, list_id: int, at: int, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (in order of their ``seq``) put into one list at a place; later rows move on."""
    n = new.count()
    length = lists.where(F.col("list_id") == list_id).count()
    if not 0 <= at <= length:
        raise VectorError("invalid_range", "the place is outside the list", "insert_at", at=at, length=length)
    moved = lists.withColumn("pos", F.when((F.col("list_id") == list_id) & (F.col("pos") >= at), F.col("pos") + n).otherwise(F.col("pos")).cast(lists.schema["pos"].dataType))
    order = F.row_number().over(Window.orderBy("seq")) - 1  # the rows of one insertion
    placed = new.withColumn("list_id", F.lit(list_id)).withColumn("pos", (order + at).cast(lists.schema["pos"].dataType))
    return moved.unionByName(placed.select(*lists.columns))


def pack_candidate(list_id: Column, pos: Column) -> Column:
    return F.shiftleft(list_id.cast("long"), 32).bitwiseOR(pos.cast("long"))


def unpack_candidate(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(0xFFFFFFFF)
