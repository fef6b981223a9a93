"""A durable, updatable graph index: stored shards, and a log of inserts and removals over them.

A folder holds ``graphs`` (a row for each shard, in a folder for each generation and shard), ``log``
(``commits.CommitLog``) and ``meta``, whose last line says which generation holds each shard and up to
which batch.  A row's shard is a hash of its id.  A log row carries the shard and the level that
was drawn for the id, so a replay takes the same steps as the first time, whatever was stored
between: the graph after a reopening, from any checkpoint, is the graph of all operations in order.

Reading replays the log into the shards that it touches, each in a task; the other shards are read
as they are.  ``checkpoint`` writes the touched shards, and no others, as a new generation.

An upsert of a known id and a removal leave a tombstone, which a search passes through and never
returns.  ``compact`` drops tombstones, shard by shard where there are any: neighbours of a dropped
node are linked anew to what it led to, degrees stay within ``m``, and a node that nobody leads to is
linked in again.  Where the rows ask for more than twice the shards (``hnsw.shards_for``) it deals all rows to more.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.operators import hnsw
from vectide.schema import Collection, VectorError, checked
from vectide.sources.commits import CommitLog


class DurableGraph:
    def __init__(self, spark: SparkSession, path: str, meta: dict[str, Any]):
        self.spark, self.path = spark, path.rstrip("/")
        self._set(meta)

    def _set(self, meta: dict[str, Any]) -> None:
        self.meta = meta
        self.settings = hnsw.Settings(**meta["settings"])
        self.metric, self.dimension, self.shards = meta["metric"], meta["dimension"], meta["shards"]
        self.schema = T.StructType.fromDDL(hnsw.GRAPHS.format(id=meta["id"]))
        kind = self.schema["ids"].dataType.elementType
        self.log_schema = T.StructType([
            T.StructField("at", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", kind),
            T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("level", T.IntegerType()), T.StructField("shard", T.IntegerType()),
        ])
        self._log = CommitLog(self.spark, f"{self.path}/log", self.log_schema)

    @classmethod
    def create(cls, spark: SparkSession, path: str, collection: DataFrame, metric: str = "euclidean", settings: hnsw.Settings = hnsw.Settings(), rows_per_shard: int = 20_000, dimension: int | None = None) -> DurableGraph:
        """A graph of a collection, which may be empty if ``dimension`` is given."""
        first = collection.select(F.size("vector")).first()
        if first is None and dimension is None:
            raise VectorError("empty_input", "no vectors, and no dimension", "graph")
        d = dimension or first[0]
        Collection(d, metric, "hnsw")
        meta = {"dimension": d, "metric": metric, "settings": vars(settings), "rows_per_shard": rows_per_shard, "id": collection.schema["id"].dataType.simpleString(), "shards": 1, "heads": [-1], "generation": -1, "upto": -1}
        graph = cls(spark, path, meta)
        graph._rebuild(checked(collection, d, "graph"), -1)
        return graph

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DurableGraph:
        try:
            lines = [json.loads(r.value) for r in spark.read.text(f"{path.rstrip('/')}/meta").collect()]
        except ValueError as e:
            raise VectorError("corrupted_data", "the description is no JSON", "graph") from e
        except Exception as e:
            raise VectorError("io_error", "no graph here", "graph", path=path) from e
        return cls(spark, path, max(lines, key=lambda m: m["generation"]))

    def _write(self, graphs: DataFrame, shards: int, heads: list[int], upto: int) -> None:
        """A new generation of some shards; the description that names it is written last."""
        generation = self.meta["generation"] + 1
        target = f"{self.path}/graphs/gen={generation}"
        graphs.write.mode("overwrite").partitionBy("shard").parquet(target)
        written = [r.shard for r in self.spark.read.schema(self.schema).parquet(target).select("shard").distinct().collect()]
        for shard in written:
            heads[shard] = generation
        self._set(self.meta | {"shards": shards, "heads": heads, "generation": generation, "upto": upto})
        self.spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/meta")

    def _rebuild(self, live: DataFrame, upto: int) -> None:
        shards = self._shards_for(live.count())
        levels = live.select("id", "vector", self._level().alias("level"), self._shard(shards).alias("shard"))
        self._write(hnsw.build_shards(hnsw.by_shard(levels, shards), self.metric, self.settings), shards, [-1] * shards, upto)

    def _shards_for(self, rows: int) -> int:
        return hnsw.shards_for(rows, self.meta["rows_per_shard"], self.dimension)

    def _level(self):
        u = F.greatest(F.shiftrightunsigned(F.xxhash64(F.lit(self.settings.seed), F.lit("level"), "id"), 11).cast("double") * 2.0**-53, F.lit(1e-9))
        return F.least(F.floor(-F.ln(u) / F.lit(float(np.log(max(self.settings.m, 2))))).cast("int"), F.lit(hnsw.MAX_LEVEL))

    def _shard(self, shards: int | None = None):
        return F.pmod(F.xxhash64("id"), F.lit(shards or self.shards)).cast("int")

    def insert(self, rows: DataFrame) -> int:
        """Upsert ``rows(id, vector)``, as one batch: all or, where one has another dimension, none.  Returns its number."""
        rows = checked(rows, self.dimension, "graph.insert")
        return self._append(rows.select(F.monotonically_increasing_id().alias("at"), F.lit("upsert").alias("op"), "id", "vector", self._level().alias("level")))

    def remove(self, ids: DataFrame | Iterable) -> int:
        """Unknown ids are passed over."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], T.StructType([self.log_schema["id"]]))
        return self._append(ids.select(F.monotonically_increasing_id().alias("at"), F.lit("remove").alias("op"), "id", F.lit(None).alias("vector"), F.lit(None).alias("level")))

    def _append(self, ops: DataFrame) -> int:
        return self._log.append(ops.withColumn("shard", self._shard()), self.meta["upto"] + 1)

    def _stored(self) -> DataFrame:
        paths = [f"{self.path}/graphs/gen={g}/shard={s}" for s, g in enumerate(self.meta["heads"]) if g >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/graphs").parquet(*paths).select(*self.schema.names)

    def graphs(self, upto: int | None = None) -> DataFrame:
        """All shards with the log replayed, as far as a batch; a table that ``hnsw.search`` takes."""
        return self._state(upto)[0]

    def _state(self, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
        """All shards, and of these the ones that the log has changed."""
        # shards are those of the present number: batches of writers that opened an earlier generation are dealt anew
        ops = self._log.rows(self.meta["upto"], upto).withColumn("shard", self._shard())
        touched = F.broadcast(ops.select("shard").distinct())  # numbers of shards
        stored = self._stored()
        before = hnsw.by_shard(stored.join(touched, "shard", "left_semi"), self.shards)
        changed = before.groupBy("shard").cogroup(hnsw.by_shard(ops, self.shards).groupBy("shard"))
        replay = _replayed(self.schema, self.metric, self.settings, self.dimension)
        changed = changed.applyInArrow(replay, self.schema)
        return stored.join(touched, "shard", "left_anti").select(*self.schema.names).unionByName(changed), changed

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, filter_mode: str = "pre", ef: int | None = None) -> DataFrame:
        """``(qid, rank, id, distance)`` of the live rows."""
        s = hnsw.Settings(**(vars(self.settings) | ({"ef_search": ef} if ef else {})))
        return hnsw.search(self.graphs(), queries, k, self.metric, s, allowed, filter_mode, rows_per_shard=self.meta["rows_per_shard"])

    def checkpoint(self) -> None:
        """Store the shards that the log has changed; a graph that was opened then replays nothing."""
        last = self._log.last()
        if last > self.meta["upto"]:
            self._write(self._state(last)[1], self.shards, list(self.meta["heads"]), last)

    def compact(self) -> None:
        """Drop tombstones from the shards that have any; deal all rows to more shards where these have outgrown."""
        self.checkpoint()
        stored = self._stored()
        live = hnsw.statistics(stored).first()["count"] or 0
        if self._shards_for(live) > 2 * self.shards:
            self._rebuild(hnsw.vectors(stored), self.meta["upto"])
            return
        worn = stored.where(F.size("dead") > 0)
        if worn.limit(1).count():
            metric, settings, schema = self.metric, self.settings, self.schema

            def run(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        ids, g = hnsw.load(batch, i, metric, settings)
                        yield hnsw.packed(batch.column(0)[i].as_py(), *hnsw.without_tombstones(ids, g), schema)

            self._write(worn.mapInArrow(run, schema), self.shards, list(self.meta["heads"]), self.meta["upto"])

    def statistics(self) -> dict[str, Any]:
        found = hnsw.statistics(self.graphs()).first()
        return {"type": "hnsw", "dimension": self.dimension, "metric": self.metric, "shards": self.shards, "generation": self.meta["generation"], "log_rows": self._log.rows(self.meta["upto"]).count(), **vars(self.settings), **found.asDict()}


def _replayed(schema: T.StructType, metric: str, settings: hnsw.Settings, d: int):
    """A function of a shard's stored row, if any, and its operations: the row after them."""
    kind = to_arrow_schema(schema)

    def run(key, stored, ops):
        import pyarrow as pa

        if stored.num_rows:
            ids, g = hnsw.load(stored.combine_chunks().to_batches()[0], 0, metric, settings)
        else:
            ids, g = pa.array([], kind.field("ids").type.value_type), hnsw.Graph(np.zeros((0, d)), metric, settings)
        ops = ops.sort_by([("batch", "ascending"), ("at", "ascending")]).combine_chunks()
        put = ops.column("op").combine_chunks().to_pylist()
        new = pa.compute.drop_null(ops.column("vector").combine_chunks())
        g.grow(new.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        where = {i: n for n, i in enumerate(ids.to_pylist()) if not g.dead[n]}
        inserted, levels = [], ops.column("level").to_pylist()
        earlier = hnsw.Earlier(g, np.array(g.levels + [level for op, level in zip(put, levels) if op == "upsert"], int))
        for op, i, level in zip(put, ops.column("id").to_pylist(), levels):
            if (old := where.pop(i, None)) is not None:
                g.dead[old] = True
            if op == "upsert":
                where[i] = len(g.levels)
                inserted.append(i)
                g.add(level, earlier.near(len(g.levels), True))
        ids = pa.concat_arrays([ids.cast(kind.field("ids").type.value_type), pa.array(inserted, kind.field("ids").type.value_type)])
        return pa.Table.from_batches([hnsw.packed(key[0].as_py(), ids, g, schema)])

    return run
