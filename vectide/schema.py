"""What a collection is, and the errors of everything that works on one."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("euclidean", "cosine", "dot", "manhattan", "chebyshev")

RECORD = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])

#: Kinds of errors by category; those of the second are worth another try with other input.
ERROR_KINDS = {
    "input": ("dimension_mismatch", "empty_input", "invalid_dimension", "invalid_id", "invalid_k", "invalid_parameter", "invalid_range", "unsupported_metric"),
    "data": ("corrupted_data", "duplicate_id", "missing_id", "unreadable_format", "version_mismatch"),
    "training": ("empty_cluster", "no_convergence", "not_trained", "too_few_samples"),
    "resource": ("capacity_exceeded", "io_error", "out_of_memory"),
    "internal": ("contract_violation", "internal_inconsistency"),
}


class VectorError(Exception):
    """An error with its kind, the operation that met it, and facts about it."""

    def __init__(self, kind: str, message: str, operation: str = "", **info: Any):
        found = [c for c, kinds in ERROR_KINDS.items() if kind in kinds]
        if not found:
            raise ValueError(f"unknown kind {kind!r}")
        super().__init__(f"{operation + ': ' if operation else ''}{message}" + (f" ({', '.join(f'{k}={v}' for k, v in info.items())})" if info else ""))
        self.kind, self.category, self.operation, self.info = kind, found[0], operation, info

    @property
    def recoverable(self) -> bool:
        return self.category in ("input", "resource")


@dataclass(frozen=True)
class Collection:
    """Dimension, metric and kind-specific settings of a set of records."""

    dimension: int
    metric: str = "euclidean"
    kind: str = "flat"
    settings: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.dimension <= 0:
            raise VectorError("invalid_dimension", "a dimension is positive", "collection", dimension=self.dimension)
        if self.metric not in METRICS:
            raise VectorError("unsupported_metric", f"no metric {self.metric!r}", "collection")
        if self.kind == "hnsw" and self.metric not in METRICS[:3]:
            raise VectorError("unsupported_metric", "graphs take euclidean, cosine and dot", "collection", metric=self.metric)


def metric_of(name: str | None) -> str:
    """A stored metric name; unknown ones count as euclidean."""
    return name if name in METRICS else "euclidean"


def checked(df: DataFrame, dimension: int, operation: str, column: str = "vector") -> DataFrame:
    """df, after a check that all its vectors have the dimension and that all its ids are set."""
    bad = df.where((F.size(column) != dimension) | F.col(column).isNull()).limit(1).collect()
    if bad:
        found = len(bad[0][column]) if bad[0][column] is not None else None
        raise VectorError("dimension_mismatch", "a vector has another dimension", operation, expected=dimension, found=found)
    return df


def check_k(k: int, operation: str) -> int:
    if not isinstance(k, int) or isinstance(k, bool):
        raise VectorError("invalid_k", "k is a whole number", operation, k=k)
    return max(0, k)
