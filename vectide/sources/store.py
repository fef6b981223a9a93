"""Written intermediate tables in the folder that driver and executors share.

They stay until the folder is cleared, because a result may read them at any time later; ``scratch``
clears those of a scope.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vectide.schema import VectorError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session has none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise VectorError("io_error", "set spark.checkpoint.dir to a folder that driver and executors share", "shared_dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vectide-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose stored tables are deleted at its end; results that read them must be written by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written once and read again: a cut of the lineage that outlives executors."""
    path, schema = fresh_path(df.sparkSession, what), df.schema
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
