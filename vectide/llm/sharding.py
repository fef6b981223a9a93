"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Each input partition is counted, which reads no column.
2. The matrix of partition-to-shard counts is drawn exactly: the partitions are halved again and
   again, and at each split the left half's rows of each shard come from hypergeometric draws out
   of what the shards still take.  A draw inverts the distribution from its mode outward, with a
   hash as its uniform number.  Shard sizes, the column sums, differ by one at most.
3. A partition permutes its rows by a hash of the row's place, and hands the first rows to the
   first shard, and so on, by its row of the matrix.
4. Rows go to cells of their shard by another hash, are sorted there by that hash, and numbered
   behind the rows of the cells before.  No task holds a whole shard.

The text moves once.  Only two tables are broadcast: the matrix, of ``MAX_ENTRIES`` counts at
most (more partitions are joined to fewer, without a shuffle), and the cells' offsets, of
``MAX_CELLS`` rows at most.

Input.  Rows are told apart by their place, so nulls in any column, empty and long texts, ties and
repeated rows are rows like any other, and an empty table gives no rows.  The place must be the
same each time the input is read: set ``stable`` for a scan of files with narrow steps on it;
other inputs are first checkpointed.  Columns of the input pass through; ``shard`` and ``slot``
are added, and take the place of columns of these names; names that begin with ``_shard_`` are
dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import cleared, hash_unit, let, pin_splits, shared_dir

MAX_ENTRIES = 1 << 20
MAX_CELLS = 1 << 20
ROWS_A_CELL = 1024

_POSITION = (1 << 33) - 1


def hypergeometric(good: Column, total: Column, drawn: Column, unit: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``good``: the inverse of the distribution at ``unit``."""
    g, t, n = (c.cast("double") for c in (good, total, drawn))
    bad = t - g
    mode = F.floor((n + 1) * (g + 1) / (t + 2)).cast("double")
    sd = F.sqrt(n * g * bad * (t - n)) / (F.greatest(t, F.lit(1.0)) * F.sqrt(F.greatest(t - 1, F.lit(1.0))))
    low, high = F.greatest(F.lit(0.0), n - bad), F.least(n, g)
    facts = F.struct(g.alias("g"), n.alias("n"), bad.alias("b"), F.greatest(low, F.least(high, mode)).alias("mode"), (F.ceil(sd * 12) + 30).alias("reach"), low.alias("low"), high.alias("high"), unit.alias("unit"))

    def body(p: Column) -> Column:
        none = F.array().cast("array<long>")
        first, last = F.greatest(p.low, p.mode - p.reach).cast("long"), F.least(p.high, p.mode + p.reach).cast("long")
        m = p.mode.cast("long")
        up = F.when(last > m, F.sequence(m + 1, last)).otherwise(none)
        down = F.when(first < m, F.sequence(m - 1, first, F.lit(-1).cast("long"))).otherwise(none)
        rise = lambda k: (p.g - k + 1) * (p.n - k + 1) / (k * (p.b - p.n + k))
        fall = lambda k: (k + 1) * (p.b - p.n + k + 1) / ((p.g - k) * (p.n - k))

        def mass(ks: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            return F.aggregate(ks, start, lambda a, k: let(a.w * ratio(k.cast("double")), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])

        def walk(ks: Column, ratio, start: Column, target: Column) -> Column:
            step = lambda a, k: F.when(a["sum"] > target, a).otherwise(let(a.w * ratio(k.cast("double")), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), k.alias("k"))))
            return F.aggregate(ks, start, step)

        def pick(target: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), m.alias("k"))
            return let(walk(up, rise, start, target), lambda a: F.when(a["sum"] > target, a.k).otherwise(walk(down, fall, F.struct(F.lit(1.0).alias("w"), a["sum"].alias("sum"), m.alias("k")), target).k))

        return let(p.unit * (F.lit(1.0) + mass(up, rise) + mass(down, fall)), pick)

    return let(facts, body)


def communication_matrix(counts: DataFrame, n_partitions: int, n_shards: int, seed: int) -> DataFrame:
    """``counts(_shard_part, n)`` to ``(_shard_part, _shard_counts array<long>, _shard_rows)``."""
    node = counts.agg(F.sort_array(F.collect_list(F.struct("_shard_part", "n"))).alias("parts"))
    zero = F.lit(0).cast("long")
    rows = F.aggregate("parts", zero, lambda a, p: a + p.n)
    node = node.select("parts", rows.alias("rows"))
    sizes = F.transform(F.sequence(zero, F.lit(n_shards - 1).cast("long")), lambda s: F.floor(F.col("rows") / n_shards) + (s < F.col("rows") % n_shards).cast("long"))
    node = node.select("parts", "rows", sizes.alias("takes"))
    for _ in range(max(0, math.ceil(math.log2(max(1, n_partitions))))):
        half = F.floor(F.size("parts") / 2).cast("int")
        left = F.slice("parts", 1, half)
        right = F.slice("parts", half + 1, F.size("parts") - half)

        def draw(acc: Column, s: Column) -> Column:
            good = F.get("takes", s.cast("int"))
            unit = hash_unit(F.lit(seed), F.get("parts", F.lit(0))["_shard_part"], F.size("parts"), s)
            return let(hypergeometric(good, acc.total, acc.n, unit), lambda h: F.struct((acc.total - good).alias("total"), (acc.n - h).alias("n"), F.concat(acc.out, F.array(h)).alias("out")))

        start = F.struct(
            F.aggregate("takes", zero, lambda a, x: a + x).alias("total"),
            F.aggregate(left, zero, lambda a, p: a + p.n).alias("n"),
            F.array().cast("array<long>").alias("out"),
        )
        drawn = F.aggregate(F.sequence(zero, F.lit(n_shards - 1).cast("long")), start, draw, lambda a: a.out)
        halves = let(drawn, lambda d: F.array(F.struct(left.alias("parts"), d.alias("takes")), F.struct(right.alias("parts"), F.zip_with("takes", d, lambda a, b: a - b).alias("takes"))))
        alone = F.array(F.struct(F.col("parts"), F.col("takes")))
        node = node.select("rows", F.explode(F.when(F.size("parts") <= 1, alone).otherwise(halves)).alias("h")).select("h.parts", "rows", "h.takes")
    return node.where(F.size("parts") > 0).select(F.get("parts", F.lit(0))["_shard_part"].alias("_shard_part"), F.col("takes").alias("_shard_counts"), F.col("rows").alias("_shard_rows"))


def shard_rows(df: DataFrame, n_shards: int, seed: int = 0, *, stable: bool = False) -> DataFrame:
    """df with ``shard`` (0 to n_shards - 1; counts at most one apart) and ``slot`` (gapless from 0 in each shard, in random order)."""
    df = cleared(df, "shard", "slot", prefix="_shard_")
    if not stable:
        shared_dir(df.sparkSession)
        df = df.checkpoint()
    pin_splits(df.sparkSession)
    counted = lambda d: d.select(F.spark_partition_id().alias("_shard_part")).groupBy("_shard_part").agg(F.count(F.lit(1)).alias("n"))
    n_partitions = counted(df).count()
    if n_partitions * n_shards > MAX_ENTRIES:
        df = df.coalesce(max(1, MAX_ENTRIES // n_shards))
        n_partitions = counted(df).count()
    matrix = communication_matrix(counted(df), n_partitions, n_shards, seed)
    ends = F.aggregate("_shard_counts", F.array().cast("array<long>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + c)))
    most = max(1, MAX_CELLS // n_shards)
    cells = F.least(F.lit(most), F.ceil(F.col("_shard_rows") / (n_shards * ROWS_A_CELL))).cast("long")
    matrix = matrix.select("_shard_part", ends.alias("_shard_ends"), F.greatest(F.lit(1), cells).alias("_shard_cells"))

    names = df.columns
    local = (
        df.withColumn("_shard_row", F.monotonically_increasing_id())
        .withColumn("_shard_part", F.spark_partition_id())
        .withColumn("_shard_key", F.xxhash64(F.lit(seed), F.lit("local"), F.col("_shard_row")))
        .sortWithinPartitions("_shard_key", "_shard_row")
        .withColumn("_shard_at", F.monotonically_increasing_id().bitwiseAND(_POSITION))
    )
    dealt = (
        local.join(F.broadcast(matrix), "_shard_part")
        .withColumn("shard", F.size(F.filter("_shard_ends", lambda e: e <= F.col("_shard_at"))))
        .withColumn("_shard_key", F.xxhash64(F.lit(seed), F.lit("shard"), F.col("_shard_row")))
        .withColumn("_shard_cell", F.pmod(F.col("_shard_key"), F.col("_shard_cells")))
        .select(*names, "shard", "_shard_cell", "_shard_key", "_shard_row")
    )
    ahead = Window.partitionBy("shard").orderBy("_shard_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_shard_cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "_shard_cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_shard_ahead"))
    inside = Window.partitionBy("shard", "_shard_cell").orderBy("_shard_key", "_shard_row")
    numbered = dealt.withColumn("_shard_n", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "_shard_cell"])
    return numbered.select(*names, "shard", (F.col("_shard_ahead") + F.col("_shard_n") - 1).alias("slot"))
