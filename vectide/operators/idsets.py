"""Sets of whole-number ids as bitmaps, a row for each 32,768 numbers.

A set is a table ``(bucket, bits)``.  It is built by one aggregation, which the map side combines;
sets are joined by bucket, and their bitmaps by numpy in Arrow batches.  A filter joins rows to
their bucket and reads one bit, so an id set of any density costs 4 kB for each bucket in use.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of bitmaps that are broadcast to a filter; larger sets are joined by a shuffle.
BROADCAST = 32_000_000
_BYTES = 4096


def _bucket(id: Column | str) -> Column:
    return F.bitmap_bucket_number(F.col(id).cast("long") if isinstance(id, str) else id)


def build(ids: DataFrame, column: str = "id") -> DataFrame:
    """The set of the ids; nulls and repeats are passed over."""
    rows = ids.where(F.col(column).isNotNull())
    return rows.groupBy(_bucket(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column).cast("long"))).alias("bits"))


def _both(name: str, how):
    @F.arrow_udf(T.BinaryType())
    def run(a, b):
        import pyarrow as pa

        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = (np.frombuffer((v or b"").ljust(_BYTES, b"\0"), np.uint8) for v in (x, y))
            out.append(how(x, y).tobytes())
        return pa.array(out, pa.binary())

    return run


def _combined(a: DataFrame, b: DataFrame, join: str, name: str, how) -> DataFrame:
    other = b.select("bucket", F.col("bits").alias("_bits"))
    out = a.join(other, "bucket", join).select("bucket", _both(name, how)("bits", "_bits").alias("bits"))
    return out.where(F.bitmap_count("bits") > 0)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "full", "or", np.bitwise_or)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "inner", "and", np.bitwise_and)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "left", "and not", lambda x, y: x & ~y)


def set_ids(ids: DataFrame, more: DataFrame, column: str = "id") -> DataFrame:
    """The set with further ids."""
    return union(ids, build(more, column))


def clear_ids(ids: DataFrame, gone: DataFrame, column: str = "id") -> DataFrame:
    """The set without some ids."""
    return subtract(ids, build(gone, column))


def count(ids: DataFrame) -> DataFrame:
    """One row: how many ids the set has."""
    return ids.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("kept"))


def contains(df: DataFrame, ids: DataFrame, column: str = "id", mask_col: str = "mask") -> DataFrame:
    """df with whether its id is in the set."""
    bits = ids.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    small = ids.count() * _BYTES <= BROADCAST
    joined = df.join(F.broadcast(bits) if small else bits, _bucket(column) == F.col("_bucket"), "left")
    at = F.bitmap_bit_position(F.col(column).cast("long"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr("1").cast("int") + F.floor(at / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.select(*df.columns, inside.alias(mask_col))


def id_pass(df: DataFrame, allow: Sequence[DataFrame] = (), deny: Sequence[DataFrame] = (), column: str = "id") -> DataFrame:
    """The rows in every allowing set and in no denying one; sets are first combined bucket by bucket, so the rows are joined once for each kind."""
    out = df
    if allow:
        both = allow[0]
        for more in allow[1:]:
            both = intersect(both, more)
        for gone in deny:
            both = subtract(both, gone)
        return contains(out, both, column, "_mask").where("_mask").drop("_mask")
    if deny:
        both = deny[0]
        for more in deny[1:]:
            both = union(both, more)
        out = contains(out, both, column, "_mask").where("not _mask").drop("_mask")
    return out
