"""Dense internal ids for outside ones, and the way back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.schema import VectorError
from vectide.sources.store import stored


def assign_ids(df: DataFrame, external: str = "external_id", first: int = 0, check: bool = True) -> DataFrame:
    """``(external, internal_id)``: ids from ``first`` on in ascending order of the outside ids.

    Ids are numbered within ranges of their order, behind the counts of the ranges before, so no
    task holds all of them.
    """
    if check:
        again = df.groupBy(external).count().where("count > 1").limit(1).collect()
        if again:
            raise VectorError("duplicate_id", "an id occurs twice", "assign_ids", id=again[0][0])
    sorted_ids = df.select(external).repartitionByRange(external).sortWithinPartitions(external)
    numbered = stored(sorted_ids.select(external, F.spark_partition_id().alias("_p")), "ids")  # a range keeps its number
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(external))
    return numbered.withColumn("_i", inside).join(F.broadcast(ahead), "_p").select(external, (F.col("_ahead") + F.col("_i") - 1 + first).alias("internal_id"))


def append_ids(known: DataFrame, new: DataFrame, external: str = "external_id", replace: bool = False) -> DataFrame:
    """``known(external, internal_id)`` and new ids behind them; a known id is an error, or gets a new number where ``replace``."""
    clash = new.join(known, external, "left_semi").limit(1).collect()
    if clash and not replace:
        raise VectorError("duplicate_id", "an id is known", "append_ids", id=clash[0][external])
    last = known.agg(F.max("internal_id")).first()[0]
    kept = known.join(new.select(external), external, "left_anti")
    return kept.unionByName(assign_ids(new, external, 0 if last is None else last + 1))


def get_or_create(known: DataFrame, wanted: DataFrame, external: str = "external_id") -> DataFrame:
    """``(external, internal_id)`` of all ids wanted: known ones keep their number, new ones follow behind the last, in order."""
    wanted = wanted.select(external).distinct()
    last = known.agg(F.max("internal_id")).first()[0]
    new = assign_ids(wanted.join(known.select(external), external, "left_anti"), external, 0 if last is None else last + 1, check=False)
    return known.join(wanted, external, "left_semi").select(external, "internal_id").unionByName(new)


def statistics(known: DataFrame) -> DataFrame:
    """One row: ids that are held, the largest number, and the numbers below it that are free (erased ids)."""
    known, top = live_ids(known), F.max("internal_id")
    return known.agg(F.count(F.lit(1)).alias("held"), top.alias("largest"), (F.coalesce(top + 1, F.lit(0)) - F.count(F.lit(1))).alias("free"))


def erase_ids(known: DataFrame, gone: DataFrame, external: str = "external_id", tombstones: bool = False) -> DataFrame:
    """known without some ids; with ``tombstones`` they stay, as ``erased``, so that their numbers are never given again."""
    if not tombstones:
        return known.join(gone.select(external), external, "left_anti")
    before = F.col("erased") if "erased" in known.columns else F.lit(False)
    marked = known.withColumn("erased", before).join(gone.select(external).distinct().withColumn("_gone", F.lit(True)), external, "left")
    return marked.withColumn("erased", F.col("erased") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def live_ids(known: DataFrame) -> DataFrame:
    """known without tombstones."""
    return known.where("not erased").drop("erased") if "erased" in known.columns else known


#: Bits of a sketch for each id, positions that an id sets, and the most bytes of a sketch: larger maps are looked up without one.
BITS_PER_ID, POSITIONS, SKETCH_BYTES = 10, 4, 32_000_000


def sketch(known: DataFrame, external: str = "external_id") -> np.ndarray | None:
    """A Bloom filter of the live ids as packed bits, to be sent to all tasks; None where it would pass SKETCH_BYTES.

    The bits are set in ranges of 32,768, each an aggregation of its own, which the map side combines.
    """
    live = live_ids(known)
    size = -(-max(1, live.count()) * BITS_PER_ID // 32_768) * 32_768
    if size // 8 > SKETCH_BYTES:
        return None
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(external)), F.lit(size)) for i in range(POSITIONS)]))
    ranges = live.select(at.alias("at")).groupBy((F.col("at") / 32_768).cast("long").alias("range")).agg(F.bitmap_construct_agg((F.col("at") % 32_768)).alias("bits"))
    out = np.zeros((size // 32_768, 4096), np.uint8)
    for r in ranges.collect():  # SKETCH_BYTES at most
        out[r.range] = np.frombuffer(bytes(r.bits).ljust(4096, b"\0"), np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, external: Column) -> Column:
    """Whether the sketch may hold an id: never false for one that it holds."""
    size = len(bits) * 8

    @F.arrow_udf("boolean")
    def run(*positions):
        import pyarrow as pa

        at = np.stack([p.to_numpy(zero_copy_only=False) for p in positions])
        return pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))

    return run(*[F.pmod(F.xxhash64(F.lit(i), external), F.lit(size)) for i in range(POSITIONS)])


def lookup_sketched(df: DataFrame, known: DataFrame, external: str = "external_id") -> DataFrame:
    """As ``lookup``, but ids that a Bloom filter stops get their -1 where they stand; only the rest is shuffled."""
    bits = sketch(known, external)
    if bits is None:
        return lookup(df, live_ids(known), external)
    passed = may_hold(bits, F.col(external))
    marked = df.withColumn("_may", F.coalesce(passed, F.lit(False)) & F.col(external).isNotNull())
    stopped = marked.where("not _may").drop("_may").withColumn("internal_id", F.lit(-1).cast("long"))
    found = lookup(marked.where("_may").drop("_may"), live_ids(known), external)
    return found.withColumn("internal_id", F.col("internal_id").cast("long")).unionByName(stopped)


def remap(df: DataFrame, known: DataFrame, internal: str = "internal_id", external: str = "external_id", name: str = "name") -> DataFrame:
    """df with the outside ids of its internal ones; unknown ones as their digits."""
    return df.join(known.select(internal, F.col(external).cast("string").alias("_e")), internal, "left").select(*df.columns, F.coalesce("_e", F.col(internal).cast("string")).alias(name))


def lookup(df: DataFrame, known: DataFrame, external: str = "external_id") -> DataFrame:
    """df with ``internal_id``; -1 for unknown ids."""
    return df.join(known.select(external, F.col("internal_id").alias("_i")), external, "left").select(*df.columns, F.coalesce("_i", F.lit(-1)).alias("internal_id"))
