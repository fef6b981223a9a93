"""Exact duplicates by skew-safe combining: locally, by salted digest groups, then over all salts.

1. Each task combines its own rows of one content (the map side of the first aggregation) under a
   salt that its partition decides.
2. The rows of one digest, content and salt are merged; a hot content thus meets in as many tasks as
   there are salts, one row a task before.
3. The winners of the salts are dealt by digest and merged again.

At each stage rows are grouped by the digest *and* the whole content, so texts that merely share a
digest stay apart.  A digest that turns out to hold several contents shows them, and rows then find
their class by the content as well; with SHA-256 that path isn't taken, with a weaker digest it is.

Rows find their class by the digest.  Classes with more than one row in ``HOT_GROUPS`` are fewer
than ``HOT_GROUPS`` and are broadcast; the others are joined by a shuffle, in which no key has more
than that share of the rows.  Only ids, digests and places are moved for it.

Nulls and odd input.  A null text is the empty text.  A null id counts as smaller than all others; a
group of null ids has a null ``keep_id``.  Of rows that share the group's largest id one is kept:
the first in the order in which the table was written down here.  Texts of any length are compared
whole.  An empty table gives no rows.  Only the id, named as it is, and the added columns come out,
so other columns can't clash; ``deduplicated`` gives the whole rows that stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import joined_by_size, stored


def _salted(df: DataFrame, salts: int | None) -> Column:
    """A salt that a row's partition decides: about the root of the tasks, so that both merges see as many rows of a hot content."""
    n = salts or max(4, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return F.pmod(F.spark_partition_id(), F.lit(n))


def exact_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] | None = None,
    salts: int | None = None,
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for each row of docs; the largest id of equal texts stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    digest = digest or (lambda c: F.sha2(c, 256))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("content")).withColumn("digest", digest(F.col("content")))
    local = rows.withColumn("salt", _salted(docs, salts)).groupBy("digest", "content", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = local.repartition("digest").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    several = F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1
    classes = stored(merged.select("digest", F.when(several, F.col("content")).alias("shown"), "keep_id", "group_size"), "exact-classes")
    sums = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows"), F.count("shown").alias("shown")).first()

    content = F.col("content") if sums.shown else F.lit(None).cast("string")
    placed = rows.select("id", "digest", content.alias("content"), F.sha2("content", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("place"))
    placed = stored(placed, "exact-rows")
    named = classes.withColumnRenamed("digest", "class_digest")
    same = (F.col("digest") == F.col("class_digest")) & (F.col("shown").isNull() | (F.col("shown") == F.col("content")))
    found = joined_by_size(placed, named, same, "group_size", sums.rows)
    found = stored(found.select("id", "keep_id", "group_size", "digest", "shown", "text_sha256", "place"), "exact-found")
    first = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "shown").agg(F.min("place").alias("place"))
    marked = found.join(first.select("place", F.lit(True).alias("kept")), "place", "left")
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce("kept", F.lit(False)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise: Callable[[Column], Column] | None = None, salts: int | None = None) -> DataFrame:
    """The whole rows of docs that stay; of rows with the same text and id the largest by the other columns.

    The same three merges, which carry the winner's columns along instead of joining them back.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    others = [c for c in docs.columns if c != id_col]
    # the text itself is carried only where it can't be told from the content
    carried = [c for c in others if normalise or c != text_col]
    best = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("given"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)))
    rows = docs.select(best.alias("best"), text.alias("content")).withColumns({"digest": F.sha2("content", 256), "salt": _salted(docs, salts)})
    local = rows.groupBy("digest", "content", "salt").agg(F.max("best").alias("best"))
    merged = local.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"))
    back = {id_col: F.col("best.id"), text_col: F.when(F.col("best.given"), F.col("content"))} | {c: F.col(f"best.c{k}") for k, c in enumerate(carried)}
    return merged.select(*(back[c].alias(c) for c in docs.columns))
