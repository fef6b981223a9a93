"""K-means: seeding, mini-batches, distributed Lloyd steps and assignment.

Seeding and mini-batch training run on the driver over a sample of at most ``SAMPLE`` rows that a
seeded hash of the id picks, so a model is the same on any layout.  Assignment and Lloyd steps run
over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators.nearest import one_nearest
from vectide.operators.sampling import bounded_sample, weighted_pick
from vectide.operators.search import dimension_of, matrix, spread
from vectide.operators.transform import CENTROID_BYTES
from vectide.schema import VectorError

#: Rows of a training sample, and bytes that it has on the driver, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 256_000_000


@dataclass
class Seeding:
    chosen: list[int]
    cost: float


def seed_plus_plus(x: np.ndarray, k: int, seed: int = 42) -> Seeding:
    """The first row at random, each further one in proportion to its squared distance to the nearest chosen."""
    n = len(x)
    if n < 1 or not 1 <= k <= n:
        raise VectorError("invalid_k", "k is from 1 to the number of rows", "seed_plus_plus", k=k, n=n)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(n))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        weights = near.copy()
        weights[chosen] = 0.0
        pick = weighted_pick(weights, rng) if weights.sum() > 0 else next(i for i in range(n) if i not in set(chosen))
        chosen.append(pick)
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    return Seeding(chosen, float(near.sum()))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid, the lowest of equals, and its squared distance; rows in slices."""
    at, best = np.empty(len(x), int), np.empty(len(x))
    for i in range(0, len(x), 4096):
        d = (x[i : i + 4096] ** 2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x[i : i + 4096] @ c.T
        at[i : i + 4096] = d.argmin(1)
        best[i : i + 4096] = np.maximum(0, d.min(1))
    return at, best


def mini_batch(x: np.ndarray, k: int, seed: int = 42, batch: int = 1024, epochs: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centroids and inertia: batches with replacement, running means, empty clusters moved to distinct far rows."""
    x = np.asarray(x, float)
    c = x[seed_plus_plus(x, k, seed).chosen].copy()
    rng, before = np.random.default_rng(seed + 1), np.inf
    inertia = float(nearest(x, c)[1].sum())
    for _ in range(epochs):
        count = np.zeros(k)
        for _ in range(-(-len(x) // min(batch, len(x)))):
            rows = x[rng.integers(len(x), size=min(batch, len(x)))]
            at, _ = nearest(rows, c)
            got = np.bincount(at, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, at, rows)
            hit = got > 0
            count[hit] += got[hit]
            c[hit] += (sums[hit] - got[hit, None] * c[hit]) / count[hit, None]
        at, best = nearest(x, c)
        empty = np.flatnonzero(np.bincount(at, minlength=k) == 0)
        far = np.argsort(-best, kind="stable")[: len(empty)]
        c[empty] = x[far]
        inertia = float(nearest(x, c)[1].sum())
        if before - inertia <= tolerance * max(before, 1e-12) and np.isfinite(before):
            break
        before = inertia
    return c, inertia


def sample_matrix(collection: DataFrame, most: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """The sampled vectors in order of their ids, as Arrow columns; wide vectors make a smaller sample (``SAMPLE_BYTES``)."""
    d = max(1, dimension_of(collection))
    rows = bounded_sample(collection.select("id", "vector"), min(most, max(1, SAMPLE_BYTES // (8 * d))), seed).toArrow()
    if not rows.num_rows:
        raise VectorError("empty_input", "no vectors to train on", "kmeans")
    rows = rows.sort_by("id")
    return matrix(rows.column("vector").combine_chunks(), d)


def train(collection: DataFrame, k: int, seed: int = 42, **settings) -> DataFrame:
    """``(list_id, centroid)`` from a bounded sample; k is cut to the rows there are."""
    x = sample_matrix(collection, seed=seed)
    c, _ = mini_batch(x, min(k, len(x)), seed, **settings)
    return centroid_table(collection.sparkSession, c)


def centroid_table(spark, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "list_id int, centroid array<double>")


def assign(collection: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(id, list_id, distance)``: the nearest centroid of each row, the lowest list of equals; no shuffle."""
    return assign_in_place(collection.select("id", "vector"), centroids, metric).select("id", "list_id", "distance")


def assign_in_place(collection: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The collection with ``list_id`` and ``distance``, by numpy on Arrow batches: no shuffle, and repeated ids stay rows of their own.

    The model goes to the tasks in blocks of at most CENTROID_BYTES, one pass over a row's task for
    each; so a large model costs more passes in the same stage, and no join.
    """
    d = dimension_of(centroids, "centroid")
    model = centroids.select("list_id", F.col("centroid").alias("_c"))
    n = model.count()
    parts = max(1, -(-n * (8 * d + 64) // CENTROID_BYTES))
    out = spread(collection, n).withColumns({"list_id": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    for p in range(parts):
        block = model if parts == 1 else model.where(F.pmod(F.xxhash64("list_id"), F.lit(parts)) == p)
        out = _assign_block(out, sorted((r.list_id, r._c) for r in block.collect()), d, metric)  # CENTROID_BYTES, about
    return out


def _assign_block(rows: DataFrame, model: list, d: int, metric: str) -> DataFrame:
    """``rows`` with ``list_id`` and ``distance`` where one of the model's centroids is nearer, or as near and of a lower list."""
    lists, c = np.array([i for i, _ in model], np.int32), np.array([row for _, row in model], float).reshape(len(model), d)
    schema, at = rows.schema, rows.columns.index("vector")
    kept = [i for i, name in enumerate(rows.columns) if name not in ("list_id", "distance")]
    list_at, distance_at = rows.columns.index("list_id"), rows.columns.index("distance")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(at), d)
            found, best = one_nearest(x, c, metric, raw=False)
            near = np.full(len(x), -1, np.int32)
            if len(lists):  # a row without a distance goes to the first list
                near, best = lists[np.maximum(found, 0)], np.where(found < 0, np.nan, best)
            old = batch.column(distance_at).fill_null(np.inf).to_numpy(zero_copy_only=False)
            old_list = batch.column(list_at).fill_null(2**31 - 1).to_numpy(zero_copy_only=False)
            keep = (old < best) | ((old == best) & (old_list < near)) | (np.isnan(best) & (~np.isnan(old) & (old < np.inf) | np.isnan(old) & (old_list < near)))
            near, best = np.where(keep, old_list, near).astype(np.int32), np.where(keep, old, best)
            none = ~np.isfinite(best) & (near == -1)
            columns = {i: batch.column(i) for i in kept} | {list_at: pa.array(near, pa.int32(), mask=none), distance_at: pa.array(best, pa.float64(), mask=none)}
            yield pa.RecordBatch.from_arrays([columns[i] for i in range(len(schema.names))], names=schema.names)

    return rows.mapInArrow(run, schema)


def cost(collection: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row ``(n, cost)``: the sum of squared distances to the nearest centroids."""
    found = assign(collection, centroids)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("cost"))


def lloyd_step(collection: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(list_id, n, centroid)`` after one step over all rows; lists without rows keep their centroid.

    Means are taken for each dimension by partial sums, which the map side combines.
    """
    d = dimension_of(centroids, "centroid")
    found = assign_in_place(collection.select("id", "vector"), centroids)
    sums = found.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(d)]).alias("_mean"))
    old = centroids.select("list_id", F.transform("centroid", lambda x: x.cast("double")).alias("_old"))
    return old.join(sums, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_mean", "_old").alias("centroid"))
