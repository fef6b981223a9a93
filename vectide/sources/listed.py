"""Inverted lists that follow a collection.

A folder holds ``centroids`` (a table for each training), ``lists`` (rows ``(list_id, id, vector,
metadata)``, in a folder for each generation and list) and ``meta``, whose last line says which
generation holds each list and up to which batch of the collection's log.

``follow`` reads the ids that later batches touched, assigns those that are left, where they stand,
and writes only the lists that lose or gain a row, as a new generation.  The result is that of a
full rebuild with the same centroids.  ``optimize`` trains anew over all records and builds the
lists again, ``compact`` builds them again with the same centroids.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators import ivf, kmeans
from vectide.schema import RECORD, VectorError
from vectide.sources.collection import DurableCollection
from vectide.sources.store import stored

ROWS = T.StructType([*RECORD.fields, T.StructField("list_id", T.IntegerType())])


class ListIndex:
    def __init__(self, collection: DurableCollection, path: str, meta: dict[str, Any]):
        self.spark, self.collection, self.path, self.meta = collection.spark, collection, path.rstrip("/"), meta

    @classmethod
    def create(cls, collection: DurableCollection, path: str, nlist: int, seed: int = 42) -> ListIndex:
        index = cls(collection, path, {"nlist": nlist, "seed": seed, "training": -1, "heads": [], "generation": -1, "upto": -1})
        index.optimize()
        return index

    @classmethod
    def open(cls, collection: DurableCollection, path: str, retrain: bool = False) -> ListIndex:
        """The stored index; with ``retrain`` it is trained and filled anew, as after loading records from elsewhere."""
        try:
            lines = [json.loads(r.value) for r in collection.spark.read.text(f"{path.rstrip('/')}/meta").collect()]
        except ValueError as e:
            raise VectorError("corrupted_data", "the description is no JSON", "lists") from e
        except Exception as e:
            raise VectorError("io_error", "no lists here", "lists", path=path) from e
        index = cls(collection, path, max(lines, key=lambda m: m["generation"]))
        if retrain:
            index.optimize()
        return index

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids/{self.meta['training']}")

    def lists(self, only: list[int] | None = None) -> DataFrame:
        """``(list_id, id, vector, metadata)`` of all lists, or of some."""
        paths = [f"{self.path}/lists/gen={g}/list_id={i}" for i, g in enumerate(self.meta["heads"]) if g >= 0 and (only is None or i in only)]
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).option("basePath", f"{self.path}/lists").parquet(*paths).select(*ROWS.names)

    def _write(self, rows: DataFrame, heads: list[int], upto: int, training: int) -> None:
        generation = self.meta["generation"] + 1
        target = f"{self.path}/lists/gen={generation}"
        rows.select(*ROWS.names).repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(target)
        for r in self.spark.read.schema(ROWS).parquet(target).select("list_id").distinct().collect():
            heads[r.list_id] = generation
        self.meta = self.meta | {"heads": heads, "generation": generation, "upto": upto, "training": training}
        self.spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/meta")

    def _fill(self, centroids: DataFrame, training: int) -> None:
        upto = self.collection._log.last()
        self._write(ivf.build(self.collection.records(), centroids), [-1] * self.meta["nlist"], upto, training)

    def optimize(self) -> None:
        """Train over the records there are, and fill all lists; a collection without records has one list, at the origin."""
        training, records = self.meta["training"] + 1, self.collection.records()
        if records.limit(1).count():
            centroids = ivf.train(records, self.meta["nlist"], self.meta["seed"])
        else:
            import numpy as np

            centroids = kmeans.centroid_table(self.spark, np.zeros((1, self.collection.config.dimension)))
        centroids.write.mode("overwrite").parquet(f"{self.path}/centroids/{training}")
        self._fill(self.spark.read.parquet(f"{self.path}/centroids/{training}"), training)

    def compact(self) -> None:
        """Fill all lists anew, with the same centroids."""
        self._fill(self.centroids(), self.meta["training"])

    def follow(self) -> int:
        """Take in what the collection's log has since; the number of lists that were written."""
        upto = self.meta["upto"]
        if self.collection._log.last() <= upto:
            return 0
        if self.collection.cleared(upto):
            self.compact()
            return len(self.meta["heads"])
        changed, last = self.collection.changes(upto)
        changed = stored(changed, "changes")
        new = stored(ivf.build(changed.where("not gone").drop("gone"), self.centroids()), "assigned")
        left = self.lists().select("list_id", "id").join(changed.select("id"), "id", "left_semi").select("list_id")
        touched = sorted({r.list_id for r in left.union(new.select("list_id")).distinct().collect()})  # numbers of lists
        kept = self.lists(touched).join(changed.select("id"), "id", "left_anti").select(*ROWS.names)
        heads = [-1 if i in set(touched) else g for i, g in enumerate(self.meta["heads"])]
        self._write(kept.unionByName(new.select(*ROWS.names)), heads, last, self.meta["training"])
        return len(touched)

    def search(self, queries: DataFrame, k: int, nprobe: int, where: Column | None = None) -> DataFrame:
        """``(qid, rank, id, distance)`` within the probed lists, by the collection's metric."""
        return ivf.search(self.lists(), self.centroids(), queries, k, nprobe, self.collection.config.metric, where)

    def statistics(self) -> dict[str, Any]:
        rows = ivf.list_stats(self.lists(), self.centroids()).agg(F.sum("length").alias("count"), F.max("length").alias("longest"), F.sum((F.col("length") == 0).cast("int")).alias("empty")).first()
        return {"type": "ivf", "nlist": self.meta["nlist"], "generation": self.meta["generation"], "behind": self.collection._log.last() - self.meta["upto"], **rows.asDict()}
