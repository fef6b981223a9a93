"""Selection: top-k, merges, first-seen dedup and bounded reservoirs, each within a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.schema import check_k


def order(score: str, ascending: bool, tie: str) -> list[Column]:
    return [F.col(score).asc() if ascending else F.col(score).desc(), F.col(tie).asc()]


def top_k(df: DataFrame, k: int, score: str = "distance", ascending: bool = True, tie: str = "id") -> DataFrame:
    """The k best rows of all, with ``rank`` from 1: a bounded heap in each task, then one merge of k rows each."""
    k = check_k(k, "top_k")
    best = df.orderBy(*order(score, ascending, tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order(score, ascending, tie))))


def top_k_by(df: DataFrame, k: int, by: str | Sequence[str] = "qid", score: str = "distance", ascending: bool = True, tie: str = "id") -> DataFrame:
    """The k best rows of each query, with ``rank`` from 1; tasks pass k rows a query on at most."""
    k = check_k(k, "top_k_by")
    by = [by] if isinstance(by, str) else list(by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order(score, ascending, tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_top_k(lists: Sequence[DataFrame], k: int, by: str = "qid", score: str = "distance", ascending: bool = True, tie: str = "id") -> DataFrame:
    """The k best of several ranked lists, without dedup; ties go by id, then by list."""
    merged = None
    for i, part in enumerate(lists):
        part = part.drop("rank").withColumn("list", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order(score, ascending, tie), F.col("list")))
    return merged.withColumn("rank", rank).where(F.col("rank") <= check_k(k, "merge_top_k"))


def first_seen(df: DataFrame, key: str = "id", pos: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """Each key's first row by position; the key is combined before it is shuffled, so a hot key costs a row a task."""
    first = F.min_by(F.struct(*df.columns), F.struct(pos)).alias("r")
    return df.groupBy(*by, key).agg(first).select("r.*")


def seen_mask(df: DataFrame, key: str = "id", pos: str = "pos", by: Sequence[str] = (), mask_col: str = "mask") -> DataFrame:
    """df with 1 at each key's first row, else 0."""
    keys = [*by, key]
    first = df.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min(pos).alias("_first"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(first, same).select(*df.columns, (F.col(pos) == F.col("_first")).cast("int").alias(mask_col))


def seen_stats(df: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct keys, duplicates and their share."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    total, unique = F.sum("n"), F.count(F.lit(1))
    return counts.groupBy(*by).agg(total.alias("total"), unique.alias("unique"), (total - unique).alias("duplicates"), ((total - unique) / total).alias("rate"))


def reservoir(df: DataFrame, capacity: int, by: str | Sequence[str] = "qid", score: str = "score", ascending: bool = True, tie: str = "id", pos: str | None = None) -> DataFrame:
    """The best ``capacity`` candidates of each query: only finite scores; with ``pos`` an id's first place counts."""
    by = [by] if isinstance(by, str) else list(by)
    finite = df.where(~F.isnan(score) & (F.abs(score) < float("inf")))
    if pos is not None:
        finite = first_seen(finite, tie, pos, by)
    return top_k_by(finite, capacity, by, score, ascending, tie)


def reservoir_counters(df: DataFrame, capacity: int, by: str | Sequence[str] = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """For each query what a ``reservoir`` with dedup sees: rows offered, finite ones, distinct ids of those, how many it keeps, and how many of the ids its threshold rejects."""
    by = [by] if isinstance(by, str) else list(by)
    finite = F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))
    counts = df.groupBy(*by, tie).agg(F.count(F.lit(1)).alias("n"), F.sum(finite.cast("long")).alias("f"))
    distinct = F.sum((F.col("f") > 0).cast("long"))
    return counts.groupBy(*by).agg(F.sum("n").alias("offered"), F.sum("f").alias("finite"), distinct.alias("distinct"), F.least(distinct, F.lit(capacity)).alias("kept"), F.greatest(distinct - capacity, F.lit(0)).alias("rejected"))
