"""Synthetic collections for benchmarks and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def random_collection(spark: SparkSession, n: int, d: int, seed: int = 123, clusters: int = 0, partitions: int | None = None) -> DataFrame:
    """``(id, vector)`` of unit vectors, uniform or around Gaussian clusters; a row depends on the seed and its id alone."""

    def run(batches):
        import pyarrow as pa

        centers = None
        if clusters:
            centers = np.random.default_rng(seed).standard_normal((clusters, d))
            centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                x = rng.uniform(-1, 1, d) if centers is None else centers[i % clusters] + rng.standard_normal(d) * 0.3 / np.sqrt(d)
                rows.append((x / np.linalg.norm(x)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], names=["id", "vector"])

    return spark.range(0, n, 1, partitions).mapInArrow(run, "id long, vector array<float>")
