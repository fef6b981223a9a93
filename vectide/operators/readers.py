"""Where exact re-ranking gets its vectors from.

A reader's ``fetch(candidates)`` gives ``(id, vector)`` of the distinct ids of ``candidates(id, ...)``
that it has.  ``rerank_scores`` and ``rerank_top_k`` take one in place of a collection; candidates
that a reader lacks count as missing.

* ``TableReader``: a collection; a join by id.
* ``ListReader``: a list store that keeps whole vectors.  Candidates that name their ``list_id`` read
  the files of their lists only, and join by list and id.
* ``CallbackReader``: any function from ids to vectors, which the tasks call with many ids at once.
  Ids are asked for once, however many queries have them, in ranges, so that a call gets neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators import lists
from vectide.operators.scan import ANY_LIST
from vectide.operators.transform import bounded
from vectide.schema import VectorError


class VectorReader(Protocol):
    def fetch(self, candidates: DataFrame) -> DataFrame: ...


class TableReader:
    def __init__(self, collection: DataFrame):
        self.collection = collection

    def fetch(self, candidates: DataFrame) -> DataFrame:
        return self.collection.select("id", "vector").join(candidates.select("id").distinct(), "id", "left_semi")


class ListReader:
    """The vectors of a list store of the formats ``flat`` and ``half``; ids are its ``external_id``."""

    def __init__(self, store: DataFrame, kind: str = "flat"):
        if kind not in lists.VECTORS:
            raise VectorError("unreadable_format", "codes are no vectors", "ListReader", format=kind)
        self.store, self.kind = store, kind

    def fetch(self, candidates: DataFrame) -> DataFrame:
        rows = self.store.select("list_id", F.col("external_id").alias("id"), "payload")
        by = ["list_id", "id"] if "list_id" in candidates.columns else ["id"]
        if "list_id" in by:
            # a broadcast that filters, so it prunes the files of a partitioned store
            named = bounded(candidates.select("list_id").where(ANY_LIST).distinct(), 1)
            rows = rows.join(named, "list_id", "left_semi")
        asked = rows.join(candidates.select(*by).distinct(), by, "left_semi")
        return asked.select("id", lists.unpack(self.kind, F.col("payload")).alias("vector"))


class CallbackReader:
    """``ask(ids)``: an array (ids, dimension) and a mask of the ids that have a vector.

    ``ids`` is a list, in ascending order.  The function goes to the tasks, which may call it again
    for the same ids when an executor is lost.
    """

    def __init__(self, ask: Callable, dimension: int):
        self.ask, self.dimension = ask, dimension

    def fetch(self, candidates: DataFrame) -> DataFrame:
        ask, d = self.ask, self.dimension
        ids = candidates.select("id").where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors, present = ask(batch.column(0).to_pylist())
                vectors, present = np.asarray(vectors, float), np.asarray(present, bool)
                if vectors.shape != (batch.num_rows, d) or present.shape != (batch.num_rows,):
                    raise VectorError("dimension_mismatch", "the callback gave another shape", "CallbackReader", expected=(batch.num_rows, d), found=vectors.shape)
                kept = np.flatnonzero(present)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * d), pa.array(vectors[kept].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), flat], names=["id", "vector"])

        return ids.mapInArrow(run, T.StructType([T.StructField("id", ids.schema["id"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType()))]))
