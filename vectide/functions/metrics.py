"""Distances and norms as Spark expressions, in double, summed from the first dimension on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this dimension a sum is written out term by term, so that it stays in generated code.
UNROLLED = 64
#: Denominators up to this count as zero: the unit in the last place of a 32-bit one.
ULP = 1.1920929e-7


def _sum(f: Callable[[Column, Column], Column], a: Column, b: Column, d: int) -> Column:
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    if d <= UNROLLED:
        return reduce(lambda x, y: x + y, [f(at(a, i), at(b, i)) for i in range(d)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column, d: int) -> Column:
    return _sum(lambda x, y: (x - y) * (x - y), a, b, d)


def dot(a: Column, b: Column, d: int) -> Column:
    return _sum(lambda x, y: x * y, a, b, d)


def manhattan(a: Column, b: Column, d: int) -> Column:
    return _sum(lambda x, y: F.abs(x - y), a, b, d)


def chebyshev(a: Column, b: Column, d: int) -> Column:
    away = lambda x, y: F.coalesce(F.abs(x.cast("double") - y.cast("double")), F.lit(float("nan")))  # noqa: E731  a maximum passes over nulls, not over NaN
    if 1 < d <= UNROLLED:
        return F.greatest(*[away(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(d)])
    return F.array_max(F.zip_with(a, b, away))


def norm_squared(a: Column, d: int) -> Column:
    return dot(a, a, d)


def clamped(score: Column) -> Column:
    """A cosine similarity held within [-1, 1]; what is no number stays none."""
    return F.when(score.isNull() | F.isnan(score), score).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def cosine_similarity(product: Column, a_squared: Column, b_squared: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a vector is as good as zero; what is no number stays none."""
    below = F.sqrt(a_squared * b_squared)
    return F.when(product.isNull() | F.isnan(product), product).when(below > ULP, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / below))).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column, d: int) -> Column:
    return F.lit(1.0) - cosine_similarity(dot(a, b, d), norm_squared(a, d), norm_squared(b, d))


def distance(metric: str, a: Column, b: Column, d: int) -> Column:
    """The smaller, the nearer, for each of the five metrics."""
    return {
        "euclidean": lambda: F.sqrt(l2_squared(a, b, d)),
        "cosine": lambda: cosine_distance(a, b, d),
        "dot": lambda: -dot(a, b, d),
        "manhattan": lambda: manhattan(a, b, d),
        "chebyshev": lambda: chebyshev(a, b, d),
    }[metric]()


def score(metric: str, a: Column, b: Column, d: int) -> Column:
    """Raw block scores: squared Euclidean distance, inner product, cosine similarity, or the distance."""
    if metric == "euclidean":
        return l2_squared(a, b, d)
    if metric == "dot":
        return dot(a, b, d)
    if metric == "cosine":
        return cosine_similarity(dot(a, b, d), norm_squared(a, d), norm_squared(b, d))
    return distance(metric, a, b, d)


def ascending(metric: str) -> bool:
    """Whether the best raw scores are the smallest."""
    return metric not in ("dot", "cosine")


def inverse_norm(a: Column, d: int) -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(norm_squared(a, d), F.lit(1e-12)))
