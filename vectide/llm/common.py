"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources.store import fresh_path, shared_dir, stored

__all__ = ["cleared", "fresh_path", "hash_unit", "joined_by_size", "let", "open_fs", "pin_splits", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin_splits(spark: SparkSession) -> None:
    """Let scans of files be cut alike each time in this session, also after executors came or went.

    Where neither setting is there, Spark takes the cores of the moment, and the places of rows in
    two scans of one table may differ.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None and spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def open_fs(uri: str):
    """The pyarrow file system and path of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


#: pyarrow's names of the schemes that Hadoop's connectors have under others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "viewfs": "hdfs"}


def cleared(df: DataFrame, *added: str, prefix: str | None = None) -> DataFrame:
    """df without columns that are named like those to be added, or begin with an operator's own prefix; case doesn't count."""
    names = {a.lower() for a in added}
    return df.drop(*[c for c in df.columns if c.lower() in names or (prefix and c.lower().startswith(prefix))])


def hash_unit(*cols: Column | str) -> Column:
    """A uniform double in [0, 1) that only the given columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


#: Groups with more than one row in so many are hot; there are fewer of them than this.
HOT_GROUPS = 1024


def joined_by_size(rows: DataFrame, groups: DataFrame, on: Column, size_col: str, total: int) -> DataFrame:
    """The inner join of ``rows`` to their ``groups``, of which ``size_col`` says how many of the ``total`` rows each has.

    Hot groups are fewer than ``HOT_GROUPS``, so they are broadcast and their rows stay where they
    are.  The rest meets by a shuffle, where no group has more than one row in ``HOT_GROUPS``.
    """
    hot = F.col(size_col) * HOT_GROUPS > total
    large = F.broadcast(groups.where(hot))
    return rows.join(large, on).unionByName(rows.join(large, on, "left_anti").join(groups.where(~hot), on))
