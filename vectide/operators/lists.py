"""Stored inverted lists: formats, reading, ingest of codes, statistics.

A list store is a table ``(list_id, pos, external_id, payload)``, partitioned by ``list_id``.  The
payload is a row's content in the store's format: ``pq8`` one byte a code, ``pq4`` two codes a byte
(the first in the low half), ``flat`` the vector's 32-bit floats, little-endian.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import codecs, metrics
from vectide.operators import ivf, pq, scan
from vectide.operators.search import dimension_of, raw_scores
from vectide.operators.topk import top_k_by
from vectide.schema import VectorError, check_k

#: Formats that keep whole vectors, as 32-bit and 16-bit floats, and all formats.
VECTORS = {"flat": "<f4", "half": "<f2"}
FORMATS = ("pq8", "pq4", *VECTORS)
SCHEMA = T.StructType([T.StructField("list_id", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("external_id", T.LongType()), T.StructField("payload", T.BinaryType())])


def _hex(values: Column, digits: int) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), digits, "0")), ""))


def _to_bytes(dtype: str):
    """An Arrow function from vectors to their numbers' bytes; numbers beyond a half's range are clamped to it."""

    @F.arrow_udf(T.BinaryType())
    def run(v):
        import pyarrow as pa
        import pyarrow.compute as pc

        width = np.dtype(dtype).itemsize
        numbers = v.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        if width == 2:
            numbers = np.clip(numbers.astype(np.float32), -codecs.HALF_MOST, codecs.HALF_MOST)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False))]) * width
        data = numbers.astype(dtype).tobytes()
        mask = v.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if none else data[a:b] for none, a, b in zip(mask, ends[:-1], ends[1:])], pa.binary())

    return run


def _from_bytes(dtype: str):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(v):
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(v), 0).to_numpy(zero_copy_only=False) // np.dtype(dtype).itemsize
        values = pa.array(np.frombuffer(b"".join(pc.drop_null(v).to_pylist()), dtype).astype(np.float32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values, mask=v.is_null())

    return run


def pack(kind: str, content: Column) -> Column:
    """Codes (``pq8``, ``pq4``) or a vector (``flat``, ``half``) as a payload."""
    if kind not in FORMATS:
        raise VectorError("unreadable_format", "no such list format", "pack", format=kind)
    if kind in VECTORS:
        return _to_bytes(VECTORS[kind])(content)
    codes = codecs.pack_nibbles(content) if kind == "pq4" else content
    return F.when(F.size(codes) == 0, F.lit(b"")).otherwise(_hex(codes, 2))


def unpack(kind: str, payload: Column, m: int | None = None) -> Column:
    """The content of a payload; ``m`` is the number of codes, which an odd ``pq4`` row needs."""
    if kind not in FORMATS:
        raise VectorError("unreadable_format", "no such list format", "unpack", format=kind)
    if kind in VECTORS:
        return _from_bytes(VECTORS[kind])(payload)
    places = F.when(F.octet_length(payload) > 0, F.sequence(F.lit(1), F.octet_length(payload))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.hex(F.substring(payload, i, 1)), 16, 10).cast("int"))
    codes = codecs.unpack_nibbles(codes) if kind == "pq4" else codes
    return codes if m is None else F.slice(codes, 1, m)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def save(store: DataFrame, path: str, kind: str, m: int) -> None:
    """The store in a folder, partitioned by list, with its format and its codes (or dimensions) a row beside it."""
    if kind not in FORMATS:
        raise VectorError("unreadable_format", "no such list format", "lists.save", format=kind)
    store.write.partitionBy("list_id").parquet(f"{path.rstrip('/')}/lists")
    store.sparkSession.createDataFrame([(json.dumps({"format": kind, "m": m}),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/meta")


def load(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, str, int]:
    """A stored list table, its format and ``m``; another format than ``kind`` is an error."""
    try:
        meta = json.loads(spark.read.text(f"{path.rstrip('/')}/meta").first().value)
        found, m = meta["format"], meta["m"]
    except (ValueError, KeyError, AttributeError) as e:
        raise VectorError("corrupted_data", "the description can't be read", "lists.load", path=path) from e
    if found not in FORMATS or (kind is not None and kind != found):
        raise VectorError("unreadable_format", "another list format", "lists.load", expected=kind, found=found)
    return spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/lists"), found, m


def ingest(store: DataFrame, rows: DataFrame, kind: str, content: str = "codes") -> DataFrame:
    """The store with ``rows(list_id, external_id, seq, <content>)`` behind the ends of their lists, in order of ``seq``."""
    new = rows.select(F.col("list_id").cast("int").alias("list_id"), F.col("external_id").cast("long").alias("external_id"), "seq", pack(kind, F.col(content)).alias("payload"))
    return ivf.append(store, new)


def read_list(store: DataFrame, list_id: int, kind: str, m: int | None = None) -> DataFrame:
    """``(pos, external_id, content)`` of one list; of a partitioned store only that list's files are read."""
    return store.where(F.col("list_id") == list_id).select("pos", "external_id", unpack(kind, F.col("payload"), m).alias("content"))


def statistics(store: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(list_id, length, bytes)`` of all lists, empty ones too."""
    sums = store.groupBy("list_id").agg(F.count(F.lit(1)).alias("length"), F.sum(F.octet_length("payload")).alias("bytes"))
    return centroids.select("list_id").join(sums, "list_id", "left").select("list_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def content_matrix(kind: str, payloads, m: int) -> np.ndarray:
    """An Arrow column of payloads of one length as an array: vectors (rows, m) in double, or codes (rows, m)."""
    import pyarrow.compute as pc

    width = {"flat": 4 * m, "half": 2 * m, "pq8": m, "pq4": -(-m // 2)}[kind]
    if (pc.fill_null(pc.binary_length(payloads), -1).to_numpy(zero_copy_only=False) != width).any():
        raise VectorError("corrupted_data", "a payload has another length", "lists.search", expected=width)
    raw = np.frombuffer(b"".join(payloads.to_pylist()), np.uint8).reshape(-1, width)
    if kind in VECTORS:
        return raw.reshape(-1).view(VECTORS[kind]).reshape(-1, m).astype(float)
    if kind == "pq8":
        return raw.astype(np.int64)
    return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), -1)[:, :m].astype(np.int64)


def search(
    store: DataFrame,
    kind: str,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int,
    metric: str = "euclidean",
    codebooks: DataFrame | None = None,
    id_map: DataFrame | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``(qid, rank, id, score)`` of the k best rows of the probed lists, read from their payloads.

    Scores are raw: squared distances, inner products or cosine similarities; of codes, which are
    those of whole vectors, by the tables of ``codebooks``, so as good as the codes.  ``id_map(internal_id, external_id)`` renames
    the ``external_id`` of the store after the top-k, and ``where`` then filters the results, so fewer
    than k may be left; an id without a name is dropped.
    """
    if kind not in FORMATS:
        raise VectorError("unreadable_format", "no such list format", "lists.search", format=kind)
    if metric not in ("euclidean", "dot", "cosine") or (kind not in VECTORS and metric == "cosine"):
        raise VectorError("unsupported_metric", "lists take euclidean and dot, vectors also cosine", "lists.search", metric=metric)
    k, d = check_k(k, "lists.search"), dimension_of(queries, "q")
    up = metrics.ascending(metric)
    if kind not in VECTORS and codebooks is None:
        raise VectorError("not_trained", "codes need their codebooks", "lists.search")
    books = None if kind in VECTORS else pq.books_of(codebooks)
    m = d if books is None else len(books)
    rows = store.select("list_id", F.col("external_id").alias("id"), "payload")
    out = None
    extra = 0 if books is None else 8 * books.shape[0] * books.shape[1]
    for block in scan.blocks(queries, d, lambda part: ivf.probes_of(centroids, part, nprobe, metric), nprobe, extra):

        def score(content, asking, _, vectors=block.vectors, kept={}):  # noqa: B006
            if books is None:
                s = raw_scores(vectors[asking], content, metric)
            else:
                if not kept:  # once a task
                    kept["tables"] = pq.tables_of(vectors, books, metric)
                s = np.zeros((len(asking), len(content)))
                for j in range(m):
                    s += kept["tables"][asking, j][:, content[:, j]]
            return s if up else -s

        found = scan.scan(rows, "payload", block, lambda c: content_matrix(kind, c, m), score, k)
        best = top_k_by(found, k)
        out = best if out is None else out.unionByName(best)
    out = out.select("qid", "rank", "id", (F.col("distance") if up else -F.col("distance")).alias("score"))
    if id_map is not None:
        names = id_map.select(F.col("internal_id").alias("id"), F.col("external_id").alias("_e"))
        out = out.join(names, "id").select("qid", "rank", F.col("_e").alias("id"), "score")
    return out if where is None else out.where(where)
