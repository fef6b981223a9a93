"""A log of batches, to which several writers may append.

A batch's rows are written to a folder of their own, which nobody reads.  Then the batch takes a
number: a small file named by it is put only if none is there; a writer that comes second tries the
next number.  So two writers neither share a number nor mix their rows, an unfinished batch is never
seen, and the next number comes from the names of the commits, without reading the log.

Local folders take the file by a hard link, others by Hadoop's ``create`` without overwriting, which
is atomic on HDFS and on stores with conditional puts.  A last commit that can't be read, or whose
rows are gone, is a torn tail: it is passed over.  Before others such a commit is an error.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.schema import VectorError


class CommitLog:
    """Rows of ``schema`` in batches; each row is read with its ``batch``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def last(self) -> int:
        """The largest number that a batch has taken; -1 without one."""
        return max(self._numbers(), default=-1)

    def _numbers(self) -> list[int]:
        fs, folder = self._files()
        if not fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for s in fs.listStatus(folder) if (name := s.getPath().getName()).endswith(".json") and name[:-5].isdigit())

    def append(self, rows: DataFrame, first: int = 0) -> int:
        """Write a batch and give it the next number, from ``first`` on."""
        name = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/data/{name}")
        number = max(first, self.last() + 1)
        while not self._put(number, json.dumps({"data": name})):
            number += 1
        return number

    def _put(self, number: int, text: str) -> bool:
        fs, folder = self._files()
        fs.mkdirs(folder)
        target = f"{self.path}/commits/{number:020d}.json"
        if fs.getUri().getScheme() == "file":
            local = self.spark._jvm.org.apache.hadoop.fs.Path(target).toUri().getPath()
            unnamed = f"{local}.{uuid.uuid4().hex}"
            with open(unnamed, "x") as f:
                f.write(text)
            try:
                os.link(unnamed, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(unnamed)
        try:
            out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(target), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def batches(self, after: int = -1) -> list[tuple[int, str]]:
        """Numbers and folders of the batches after one, in order."""
        fs, _ = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        numbers = [n for n in self._numbers() if n > after]
        if not numbers:
            return []
        lines = self.spark.read.text([f"{self.path}/commits/{n:020d}.json" for n in numbers]).select("value", "_metadata.file_name").collect()
        said = {int(r.file_name[:20]): r.value for r in lines}
        found: list[tuple[int, str]] = []
        for n in numbers:
            try:
                folder = f"{self.path}/data/{json.loads(said[n])['data']}"
                whole = fs.exists(path(f"{folder}/_SUCCESS"))
            except (ValueError, KeyError, TypeError):
                whole = False
            if whole:
                found.append((n, folder))
            elif n != numbers[-1]:
                raise VectorError("corrupted_data", "a batch before others can't be read", "log", batch=n)
        return found

    def rows(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """The rows of the batches after one, with ``batch``; all of a batch or none."""
        found = [(n, f) for n, f in self.batches(after) if upto is None or n <= upto]
        if not found:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())]))
        read = self.spark.read.schema(self.schema).parquet(*[f for _, f in found]).withColumn("_data", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        names = self.spark.createDataFrame([(f.rpartition("/")[2], n) for n, f in found], "_data string, batch long")
        return read.join(F.broadcast(names), "_data").drop("_data")

    def forget(self, upto: int) -> None:
        """Delete the rows of batches that a snapshot has taken in; the last commit stays, for its number."""
        fs, _ = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for n, folder in self.batches():
            if n <= upto:
                if n < self.last():
                    fs.delete(path(f"{self.path}/commits/{n:020d}.json"), False)
                    fs.delete(path(folder), True)
