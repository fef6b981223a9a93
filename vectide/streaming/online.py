"""Streams: centroids and codebooks that follow arriving vectors, and logs that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectide.operators import kmeans
from vectide.schema import VectorError
from vectide.sources.store import stored

STATE = "list_id int, n long, centroid array<double>"


def fold_batch(state: DataFrame, batch: DataFrame, decay: float | None = None) -> DataFrame:
    """``state(list_id, n, centroid)`` after the vectors of ``batch(id, vector)``.

    Rows go to the centroids as they were before the batch; a task sends one sum for each centroid.
    Without a decay a centroid is the mean of all rows that it ever had.  With a decay ``a`` a batch
    of ``m`` rows weighs ``1 - (1 - a) ** m`` against what was before, as ``m`` steps of ``a`` do;
    the rows of a batch weigh alike, so their order doesn't matter.
    """
    found = kmeans.assign_in_place(batch.select("id", "vector"), state.select("list_id", "centroid"))
    d = len(state.first()["centroid"])
    sums = found.groupBy("list_id").agg(F.count(F.lit(1)).alias("m"), F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(d)]).alias("mean"))
    share = F.col("m") / (F.col("n") + F.col("m")) if decay is None else 1 - F.pow(F.lit(1.0 - decay), F.col("m"))
    moved = F.zip_with("centroid", "mean", lambda c, x: c + (x - c) * F.col("share"))
    joined = state.join(sums, "list_id", "left").withColumn("share", share)
    return joined.select("list_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce(moved, "centroid").alias("centroid"))


def state_of(spark: SparkSession, path: str, batch: int | None = None) -> tuple[int, DataFrame]:
    """The last finished state below ``path``, or the last before a batch, and its batch number (-1: the beginning)."""
    states = spark.read.schema(STATE + ", batch long").parquet(path)
    numbers = [r.batch for r in states.select("batch").distinct().collect() if batch is None or r.batch < batch]  # a number a batch
    if not numbers:
        raise VectorError("not_trained", "no state here", "state_of", path=path)
    return max(numbers), states.where(F.col("batch") == max(numbers)).drop("batch")


#: States of earlier batches that are kept, for batches that are delivered again.
KEPT = 3


def _write_state(spark: SparkSession, state: DataFrame, path: str, number: int) -> None:
    """A batch's state; those of long ago are deleted, so that the folder and its listing stay small."""
    state.write.mode("overwrite").parquet(f"{path}/batch={number}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < number - KEPT:
            fs.delete(s.getPath(), True)


def follow_centroids(stream: DataFrame, first: DataFrame, path: str, checkpoint: str, decay: float | None = None) -> StreamingQuery:
    """Centroids that follow ``stream(id, vector)``, from ``first(list_id, centroid)`` on.

    Each batch's state is written below ``path`` under the batch's number, so a query that starts
    again goes on from the last one, and a batch that is delivered again is written over.
    """
    spark = stream.sparkSession
    begin = first.select(F.col("list_id").cast("int").alias("list_id"), F.lit(0).cast("long").alias("n"), F.col("centroid").cast("array<double>").alias("centroid"))
    try:
        state_of(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        begin.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def update(batch: DataFrame, number: int) -> None:
        _, state = state_of(spark, path, number)
        _write_state(spark, fold_batch(state, batch, decay), path, number)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_codebooks(stream: DataFrame, first: DataFrame, m: int, path: str, checkpoint: str, decay: float | None = None, most: int | None = None, repair: bool = True) -> StreamingQuery:
    """Codebooks ``first(sub, code, centroid)`` that follow ``stream(id, vector)``; read them by ``codebooks_of``.

    A batch is read once: each row's parts are assigned together, and a task sends one sum for each
    sub-space and code.  A state's ``list_id`` is ``sub * 65536 + code``.  ``most`` thins larger batches
    to about so many rows, by a hash of the id and the batch.  With ``repair`` a code that no row has
    ever come to moves to one of the batch's farthest parts, the next one to the next.
    """
    import numpy as np

    from vectide.operators import pq

    spark = stream.sparkSession
    begin = first.select((F.col("sub") * 65_536 + F.col("code")).cast("int").alias("list_id"), F.lit(0).cast("long").alias("n"), F.col("centroid").cast("array<double>").alias("centroid"))
    try:
        state_of(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        begin.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def update(batch: DataFrame, number: int) -> None:
        _, state = state_of(spark, path, number)
        old = {r.list_id: r.n for r in state.select("list_id", "n").collect()}  # a model of bounded size
        books = pq.books_of(state.select(F.expr("cast(list_id div 65536 as int)").alias("sub"), F.expr("cast(list_id % 65536 as int)").alias("code"), "centroid"))
        if most is not None and (rows := batch.count()) > most:
            batch = batch.where(F.pmod(F.xxhash64(F.lit(number), "id"), F.lit(1_000_000)) < int(1_000_000 * most / rows))
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(books.shape[2])]
        passed = stored(pq.lloyd_sums(batch.select("vector"), books), "codebook-batch")  # tasks x codes
        n = {j * 65_536 + c: old.get(j * 65_536 + c, 0) for j in range(m) for c in range(books.shape[1])}
        for r in passed.where("code >= 0").groupBy("sub", "code").agg(F.sum("n").alias("n"), *sums).collect():
            key, mean = r["sub"] * 65_536 + r["code"], np.array([r[f"s{i}"] for i in range(books.shape[2])]) / r["n"]
            share = r["n"] / (n[key] + r["n"]) if decay is None else 1 - (1 - decay) ** r["n"]
            books[r["sub"], r["code"]] += (mean - books[r["sub"], r["code"]]) * share
            n[key] += r["n"]
        if repair and not all(n.values()):
            far: dict[int, list] = {}
            for r in passed.where("code < 0 and error > 0").orderBy(F.desc("error"), "place").limit(len(n)).collect():
                far.setdefault(r["sub"], []).append(np.array(r["sums"]))
            for key in sorted(k for k, count in n.items() if not count):
                if far.get(key // 65_536):
                    books[key // 65_536, key % 65_536] = far[key // 65_536].pop(0)
        rows = [(key, count, books[key // 65_536, key % 65_536].tolist()) for key, count in n.items()]
        _write_state(spark, spark.createDataFrame(rows, STATE), path, number)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def codebooks_of(spark: SparkSession, path: str) -> DataFrame:
    """The last state of ``follow_codebooks`` as ``(sub, code, centroid)``."""
    _, state = state_of(spark, path)
    return state.select(F.expr("cast(list_id div 65536 as int)").alias("sub"), F.expr("cast(list_id % 65536 as int)").alias("code"), "centroid")


def ingest_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving log rows to a log table; a batch that is delivered again is written over, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_lengths(frames: DataFrame) -> DataFrame:
    """``frames(list_id, seq, length, intact)``: each list's last committed length, up to the first damaged frame."""
    broken = frames.where(~F.col("intact")).agg(F.coalesce(F.min("seq"), F.lit(2**62)).alias("_end"))
    good = frames.join(F.broadcast(broken)).where("seq < _end")
    return good.groupBy("list_id").agg(F.max_by("length", "seq").alias("length"))
