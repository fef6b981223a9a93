"""A durable collection: an immutable snapshot and a log of operations over it.

A log row is ``(seq, op, id, vector, metadata)``; ``op`` is upsert, remove, update or clear.  The
live view replays it: per id the last upsert or remove counts, updates after an upsert fill the
fields that they set, and nothing before the last clear is seen.  Appends are atomic, and several
writers may append at once (``commits.CommitLog``): batches are numbered, and rows count in order of
``(batch, seq)``.  A log that a checkpoint has taken in may be replayed again without effect.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators import search
from vectide.schema import RECORD, Collection, VectorError, checked, metric_of
from vectide.sources.commits import CommitLog

LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *[T.StructField(f.name, f.dataType) for f in RECORD]])
VERSION = 1


def live_view(snapshot: DataFrame | None, log: DataFrame) -> DataFrame:
    """``(id, vector, metadata)`` of all records that are left; one shuffle by id, combined before it.

    A log with ``batch`` counts in order of ``(batch, seq)``, another one in order of ``seq``.
    """
    batched = "batch" in log.columns
    if snapshot is not None:
        before = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("op"), "id", "vector", "metadata")
        log = log.unionByName(before.withColumn("batch", F.lit(-1).cast("long")) if batched else before)
    nothing = F.lit(-2).cast("long")
    log = log.withColumn("_at", F.struct("batch", "seq") if batched else F.col("seq"))
    cleared = log.where("op = 'clear'").agg(F.coalesce(F.max("_at"), F.struct(nothing.alias("batch"), nothing.alias("seq")) if batched else nothing).alias("_cleared"))
    ops = log.where("op <> 'clear'").join(F.broadcast(cleared)).where("_at > _cleared")
    # the last write of an id, and after it the last update of each field
    at = F.col("_at")
    whole = F.when(F.col("op").isin("upsert", "remove"), at)
    last = ops.groupBy("id").agg(
        F.max(whole).alias("at"),
        F.max_by(F.struct("op", "vector", "metadata"), whole).alias("w"),
        F.max(F.when((F.col("op") == "update") & F.col("vector").isNotNull(), at)).alias("v_at"),
        F.max_by("vector", F.when((F.col("op") == "update") & F.col("vector").isNotNull(), at)).alias("v"),
        F.max(F.when((F.col("op") == "update") & F.col("metadata").isNotNull(), at)).alias("m_at"),
        F.max_by("metadata", F.when((F.col("op") == "update") & F.col("metadata").isNotNull(), at)).alias("m"),
    )
    kept = last.where("at is not null and w.op = 'upsert'")
    return kept.select("id", F.when(F.col("v_at") > F.col("at"), F.col("v")).otherwise(F.col("w.vector")).alias("vector"), F.when(F.col("m_at") > F.col("at"), F.col("m")).otherwise(F.col("w.metadata")).alias("metadata"))


def as_records(spark: SparkSession, items) -> DataFrame:
    """``(seq, id, vector, metadata)`` of what a program holds, in its order.

    ``items`` is a DataFrame of Spark, pandas or Arrow with ``id``, ``vector`` and, where there is
    one, ``metadata``; a mapping from ids to vectors; or tuples ``(id, vector[, metadata])``.  A
    vector is any sequence or array of numbers.
    """
    if isinstance(items, DataFrame):
        rows = items if "metadata" in items.columns else items.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        return rows.select(F.monotonically_increasing_id().alias("seq"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "metadata")
    if hasattr(items, "to_pylist"):  # an Arrow table
        items = [(r["id"], r["vector"], r.get("metadata")) for r in items.to_pylist()]
    elif hasattr(items, "itertuples"):  # of pandas
        named = items["metadata"] if "metadata" in items else [None] * len(items)
        items = list(zip(items["id"], items["vector"], named))
    elif isinstance(items, Mapping):
        items = list(items.items())

    def row(seq: int, id, vector, metadata=None) -> tuple:
        numbers = None if vector is None else [float(x) for x in vector]
        none = metadata is None or metadata != metadata  # pandas has NaN where nothing is
        return seq, str(id), numbers, None if none else dict(metadata)

    schema = T.StructType([LOG["seq"], *RECORD.fields])
    return spark.createDataFrame([row(i, *item) for i, item in enumerate(items)], schema).coalesce(1)


class DurableCollection:
    """A collection in a folder: ``snapshot`` and ``log`` tables and ``meta``, a one-line JSON text."""

    def __init__(self, spark: SparkSession, path: str, config: Collection):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._log = CommitLog(spark, f"{self.path}/log", LOG)

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Collection) -> DurableCollection:
        c = cls(spark, path, config)
        c._write_snapshot(spark.createDataFrame([], RECORD), 0, -1)
        return c

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str | None = None) -> DurableCollection:
        meta = cls._meta(spark, path)
        if meta.get("version") != VERSION:
            raise VectorError("version_mismatch", "another version wrote this", "open", version=meta.get("version"))
        if kind is not None and meta["type"] != kind:
            raise VectorError("unreadable_format", "another kind of collection", "open", expected=kind, found=meta["type"])
        return cls(spark, path, Collection(meta["dimension"], metric_of(meta["metric"]), meta["type"], meta.get("settings", {})))

    @staticmethod
    def _meta(spark: SparkSession, path: str) -> dict[str, Any]:
        try:
            lines = spark.read.text(f"{path.rstrip('/')}/meta").collect()
            found = [json.loads(r.value) for r in lines]
        except ValueError as e:
            raise VectorError("corrupted_data", "the description is no JSON", "open") from e
        except Exception as e:
            raise VectorError("io_error", "no collection here", "open", path=path) from e
        if not found:
            raise VectorError("corrupted_data", "no description", "open")
        return max(found, key=lambda m: m["generation"])

    def _write_snapshot(self, records: DataFrame, generation: int, upto: int) -> None:
        records.write.mode("overwrite").parquet(f"{self.path}/snapshot/{generation}")
        meta = {"type": self.config.kind, "version": VERSION, "dimension": self.config.dimension, "metric": self.config.metric, "settings": self.config.settings, "generation": generation, "upto": upto}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/meta")

    def log(self) -> DataFrame:
        """All log rows that no snapshot has taken in, with their ``batch``."""
        return self._log.rows(self._meta(self.spark, self.path)["upto"])

    def records(self) -> DataFrame:
        generation = self._meta(self.spark, self.path)["generation"]
        return live_view(self.spark.read.schema(RECORD).parquet(f"{self.path}/snapshot/{generation}"), self.log())

    def _append(self, ops: DataFrame) -> None:
        """One atomic batch, numbered behind those that are there and the snapshot."""
        self._log.append(ops, self._meta(self.spark, self.path)["upto"] + 1)

    def changes(self, after: int = -1) -> tuple[DataFrame, int]:
        """``(id, vector, metadata, gone)`` of each id that the batches after one touch, and the last batch.

        What an index follows (``lists.follow``).  Ids that are left have their present record; after a
        clear the ids of all earlier records are gone too, which an index learns from ``cleared``.
        """
        last = self._log.last()
        touched = self._log.rows(after, last)
        now = self.records().withColumn("_live", F.lit(True))
        ids = touched.where("op <> 'clear'").select("id").distinct()
        found = ids.join(now, "id", "left").select("id", "vector", "metadata", F.col("_live").isNull().alias("gone"))
        return found, last

    def cleared(self, after: int = -1) -> bool:
        """Whether a batch after one clears the collection."""
        return bool(self._log.rows(after).where("op = 'clear'").limit(1).count())

    def _ops(self, rows: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOG).coalesce(1)

    def upsert(self, items: DataFrame | Mapping | Iterable[tuple]) -> None:
        """All items (``as_records``) or, where one has another dimension, none."""
        records = as_records(self.spark, items).withColumn("op", F.lit("upsert"))
        self._append(checked(records.select(*[f.name for f in LOG]), self.config.dimension, "upsert"))

    def remove(self, ids: Iterable[str]) -> None:
        """Unknown ids are passed over."""
        self._append(self._ops(("remove", i, None, None) for i in ids))

    def update(self, id: str, vector: Sequence[float] | None = None, metadata: dict[str, str] | None = None) -> bool:
        """Fields that are None stay as they are; False where the id is unknown."""
        if vector is not None and len(vector) != self.config.dimension:
            raise VectorError("dimension_mismatch", "a vector has another dimension", "update", expected=self.config.dimension, found=len(vector))
        if not self.contains(id):
            return False
        numbers = None if vector is None else [float(x) for x in vector]
        self._append(self._ops([("update", id, numbers, metadata)]))
        return True

    def clear(self) -> None:
        self._append(self._ops([("clear", None, None, None)]))

    def contains(self, id: str) -> bool:
        return bool(self.records().where(F.col("id") == id).limit(1).count())

    def count(self) -> int:
        return self.records().count()

    def compact(self, keep_log: bool = True) -> None:
        """A new snapshot that takes the log in; the description that names it is written last.

        ``keep_log=False`` deletes the batches that are taken in, which indexes then can't follow.
        """
        meta, last = self._meta(self.spark, self.path), self._log.last()
        generation = self.spark.read.schema(RECORD).parquet(f"{self.path}/snapshot/{meta['generation']}")
        self._write_snapshot(live_view(generation, self._log.rows(meta["upto"], last)), meta["generation"] + 1, max(meta["upto"], last))
        if not keep_log:
            self._log.forget(last)

    def search(self, queries, k: int, where: Column | None = None, filter_mode: str = "pre", norms: str | None = None) -> DataFrame:
        """``(qid, rank, id, distance)`` by the collection's metric.

        ``queries`` is ``DataFrame(qid, q)``, or one vector or several, as ``search.as_queries`` takes them.
        """
        asked = queries if isinstance(queries, DataFrame) else search.as_queries(self.spark, queries)
        found = search.dimension_of(asked, "q")
        if found != self.config.dimension:
            raise VectorError("dimension_mismatch", "a query has another dimension", "search", expected=self.config.dimension, found=found)
        return search.batch_knn(self.records(), asked, k, self.config.metric, where, filter_mode=filter_mode, norms=norms)

    def statistics(self) -> dict[str, Any]:
        """Counts and settings; ``fragmentation`` is the share of stored vectors that are not live any more."""
        meta = self._meta(self.spark, self.path)
        log = self._log.rows(meta["upto"]).agg(F.count(F.lit(1)).alias("rows"), F.count("vector").alias("vectors")).first()
        stored = self.spark.read.schema(RECORD).parquet(f"{self.path}/snapshot/{meta['generation']}").count() + log.vectors
        count = self.count()
        sizes = {"vector_bytes": 4 * self.config.dimension * count, "fragmentation": max(0.0, 1 - count / stored) if stored else 0.0}
        return {"type": self.config.kind, "count": count, "dimension": self.config.dimension, "metric": self.config.metric, "log_rows": log.rows, **sizes, **self.config.settings}


def export_json(records: DataFrame, config: Collection, path: str) -> None:
    """One JSON text for each record, each with the collection's description."""
    head = [F.lit(config.kind).alias("type"), F.lit(VERSION).alias("version"), F.lit(config.dimension).alias("dimension"), F.lit(config.metric).alias("metric"), F.lit(json.dumps(config.settings)).alias("settings")]
    records.select(*head, "id", "vector", "metadata").write.mode("overwrite").json(path)


#: Kinds that may be opened as another one: records are the same.
_ALSO = {("flat_optimized", "flat")}


def import_json(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, Collection]:
    """Records and their description; another kind than ``kind`` is an error, but for plain records where optimised ones are asked for."""
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("dimension", T.IntegerType()), T.StructField("metric", T.StringType()), T.StructField("settings", T.StringType()), *RECORD.fields])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    try:
        head = rows.select("type", "version", "dimension", "metric", "settings").first()
        settings = json.loads(head.settings) if head and head.settings else {}
    except Exception as e:
        raise VectorError("corrupted_data", "a record is no JSON", "import_json") from e
    if head is None:
        raise VectorError("empty_input", "no records", "import_json")
    if kind is not None and head.type != kind and (kind, head.type) not in _ALSO:
        raise VectorError("unreadable_format", "another kind of collection", "import_json", expected=kind, found=head.type)
    return rows.select("id", "vector", "metadata"), Collection(head.dimension, metric_of(head.metric), head.type or "flat", settings)


def with_checksum(df: DataFrame) -> DataFrame:
    """df with a CRC-32 over each row."""
    return df.withColumn("crc", F.crc32(F.to_json(F.struct(*df.columns)).cast("binary")))


def verify_checksum(df: DataFrame) -> DataFrame:
    """The rows of ``with_checksum``; a damaged one is an error."""
    kept = [c for c in df.columns if c != "crc"]
    bad = df.where(F.crc32(F.to_json(F.struct(*kept)).cast("binary")) != F.col("crc")).limit(1).count()
    if bad:
        raise VectorError("corrupted_data", "a checksum does not hold", "verify_checksum")
    return df.select(*kept)
