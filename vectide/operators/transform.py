"""Vector transforms: norms, residuals, inner product to Euclidean, block layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import codecs, metrics
from vectide.operators import search
from vectide.operators.search import all_pairs, dimension_of, query_blocks, raw_scores
from vectide.operators.topk import top_k_by
from vectide.schema import VectorError

#: Centroid tables up to this many bytes are broadcast, larger ones joined by a shuffle.
CENTROID_BYTES = 32_000_000


def norms(collection: DataFrame) -> DataFrame:
    """``(id, norm_sq, inv_norm)``."""
    d = dimension_of(collection)
    return collection.select("id", metrics.norm_squared(F.col("vector"), d).alias("norm_sq"), metrics.inverse_norm(F.col("vector"), d).alias("inv_norm"))


def update_norms(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """A table of ``norms`` after vectors were added or replaced: only those of ``changed(id, vector)`` are computed."""
    return cache.join(changed.select("id"), "id", "left_anti").unionByName(norms(changed))


def with_norms(collection: DataFrame, half: bool = False) -> DataFrame:
    """The collection with ``inv_norm`` beside the vector, so that later searches neither sum nor join.

    ``half`` keeps the bits of 16-bit floats instead, as ``inv_norm_half``: two bytes a row.
    """
    inverse = metrics.inverse_norm(F.col("vector"), dimension_of(collection))
    return collection.withColumn("inv_norm_half", codecs.half_bits(inverse)) if half else collection.withColumn("inv_norm", inverse)


def _inverse(rows: DataFrame) -> DataFrame:
    """``(id, vector, _x)`` with the inverse norms that are kept beside the vectors."""
    if "inv_norm" in rows.columns:
        inverse = F.col("inv_norm")
    elif "inv_norm_half" in rows.columns:
        inverse = codecs.from_half_bits(F.col("inv_norm_half"))
    else:
        raise VectorError("missing_id", "neither a cache nor norms beside the vectors", "cosine_with_norms")
    return rows.select("id", "vector", inverse.alias("_x"))


def cosine_with_norms(collection: DataFrame, cache: DataFrame | None, queries: DataFrame, clamp: bool = False) -> DataFrame:
    """``(qid, id, score)``: cosine similarity from stored inverse norms; queries go in blocks.

    Norms that are kept beside the vectors (``with_norms``) are taken as they are; those of a cache
    are joined by id.  ``clamp`` holds scores within [-1, 1], which rounded norms may miss.
    """
    d = dimension_of(queries, "q")
    rows = collection if cache is None else collection.select("id", "vector").join(cache, "id")
    rows, out = _inverse(rows), None

    def score(q, x, q_inverse, x_inverse):
        s = raw_scores(q, x, "dot") * q_inverse[0][:, None] * x_inverse[0][None]
        return np.clip(s, -1.0, 1.0) if clamp else s

    for block in query_blocks(queries, d):
        asked = block.select("qid", "q", metrics.inverse_norm(F.col("q"), d).alias("_i"))
        part = all_pairs(rows, asked, "score", T.DoubleType(), score)
        out = part if out is None else out.unionByName(part)
    return out


def nearest_with_norms(collection: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, id, score)``: the k best by the clamped scores of ``cosine_with_norms``, of norms beside the vectors; only k rows a query leave a task.

    Ids are integers; a row or query that has no number for a score is not found.
    """
    d, out = dimension_of(queries, "q"), None
    rows = _inverse(collection)
    for block in query_blocks(queries, d):
        asked = block.select("qid", "q", metrics.inverse_norm(F.col("q"), d).alias("_i"))
        found = search._arrow_nearest(rows, asked, "dot", k, raw=True, weighted=True)
        best = top_k_by(found, k, ascending=False).select("qid", "rank", "id", F.col("distance").alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


def bounded(table: DataFrame, d: int):
    """The table, marked for broadcast only if a count shows that it is small."""
    return F.broadcast(table) if table.count() * (8 * d + 64) <= CENTROID_BYTES else table


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """``assigned(id, vector, list_id)`` with ``residual``: the vector less its centroid; a list without one is an error."""
    d = dimension_of(centroids, "centroid")
    joined = assigned.join(bounded(centroids.select("list_id", F.col("centroid").alias("_c")), d), "list_id", "left")
    known = F.when(F.col("_c").isNull(), F.raise_error(F.lit("an assignment without a centroid"))).otherwise(F.zip_with("vector", "_c", lambda x, c: x.cast("double") - c.cast("double")))
    return joined.select("id", "list_id", "vector", known.alias("residual"))


def mips_radius(collection: DataFrame) -> float:
    """The squared radius that all vectors lie within, with a little room."""
    d = dimension_of(collection)
    found = collection.agg(F.max(metrics.norm_squared(F.col("vector"), d))).first()[0]
    if found is None:
        raise VectorError("empty_input", "no vectors", "mips_radius")
    return found * (1 + 1e-6)


def mips_augment(collection: DataFrame, radius: float) -> DataFrame:
    """``(id, vector)`` with one more dimension, which brings each norm to the radius."""
    d = dimension_of(collection)
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(radius) - metrics.norm_squared(F.col("vector"), d)))
    return collection.select("id", F.concat(F.transform("vector", lambda x: x.cast("double")), F.array(rest)).alias("vector"))


def mips_scores(collection: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """``(qid, id, score)``: the squared distances that augmented vectors would have, from inner products."""
    d = dimension_of(queries, "q")
    out = None

    def score(q, x, *_):
        return (search._norms(q) + radius)[:, None] - raw_scores(q, x, "dot") * 2

    for block in query_blocks(queries, d):
        part = all_pairs(collection.select("id", "vector"), block.select("qid", "q"), "score", T.DoubleType(), score)
        out = part if out is None else out.unionByName(part)
    return out


def interleave(vectors: DataFrame, group: int) -> DataFrame:
    """``(id, vector)`` to blocks ``(block, ids, values)``: for each dimension the values of ``group`` rows side by side.

    Rows are grouped by id, so ids are dense from 0; a last block may be short.
    """
    grouped = vectors.groupBy(F.expr(f"id div {group}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("r"))
    at = lambda j: F.transform("r", lambda x: F.get(x.vector, j))
    values = F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.element_at("r", 1).vector) - 1), at))
    return grouped.select("block", F.transform("r", lambda x: x.id).alias("ids"), values.alias("values"))


def deinterleave(blocks: DataFrame) -> DataFrame:
    """The rows of ``interleave``."""
    n = F.size("ids")
    rows = blocks.select("values", n.alias("n"), F.posexplode("ids").alias("at", "id"))
    own = F.transform(F.sequence(F.lit(0), F.expr("size(values) div n") - 1), lambda j: F.get("values", j * F.col("n") + F.col("at")))
    return rows.select("id", own.alias("vector"))
