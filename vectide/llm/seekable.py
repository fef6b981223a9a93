"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order: frame ``i`` is document ``i``'s ids, little-endian
uint32, compressed by itself with zstandard's own checksum.  Then come a skippable frame with the
documents' ids (a null flag and an int64 each) and the seek table of zstandard's seekable format:
for each frame its compressed and decompressed size and the low half of the XXH64 of its content.
A reader opens a file at its end, and decompresses only the frames that are asked for:
``read_documents`` finds them by document id in the files whose range of ids may hold it.

Nulls and odd input.  A null text is the empty text: its document is the end id alone.  A null
document id sorts first and comes back as null.  Repeated ids are documents of their own, ordered
by a hash of their text, then by text; ids are whole numbers.  Ranges are cut by id and hash, so
rows of one id, or without one, are spread over files; only equal rows stay together.  An empty table makes no file and no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectide.llm.common import fresh_path, open_fs
from vectide.llm.tokenizing import piece_encoder

_SKIPPABLE, _TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
LEVEL = 3

FILES = "file string, ordinal long, n_docs long, n_tokens long, first_id long, last_id long, nulls boolean"
ROWS = "file string, ordinal long, frame int, doc_id long, file_start long, n_tokens long, ids binary"


class FrameWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self.first = self.last = None
        self.nulls = False

    def add(self, key: int | None, ids: bytes) -> None:
        import xxhash

        z = self.zip.compress(ids)
        self.out.write(z)
        self.table.append(struct.pack("<III", len(z), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.keys.append(struct.pack("<?q", key is None, key or 0))
        self.tokens += len(ids) // 4
        if key is None:
            self.nulls = True
        else:
            self.first, self.last = key if self.first is None else self.first, key

    def close(self) -> None:
        import xxhash

        keys = b"".join(self.keys)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(keys)) + keys)
        self.table.append(struct.pack("<III", len(keys) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.table)
        self.out.write(struct.pack("<II", _TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), _CHECKSUMS, _SEEKABLE))
        self.out.close()


def read_tables(source) -> tuple[list[tuple[int, int, int]], bytes]:
    """The seek table, whose last entry is the table of ids, and the table of ids."""
    size = source.size()
    n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != _SEEKABLE or flags != _CHECKSUMS:
        raise ValueError("no seek table")
    table = list(struct.iter_unpack("<III", source.read_at(12 * n, size - 9 - 12 * n)))
    return table, source.read_at(table[-1][0] - 8, size - 9 - 12 * n - 8 - table[-1][0] + 8)


def read_frames(source, wanted: list[int] | None = None) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(frame, document id, tokens before it in the file, ids) of the frames wanted, of all for None."""
    import xxhash
    import zstandard

    table, keys = read_tables(source)
    unzip = zstandard.ZstdDecompressor()
    at = start = 0
    chosen = None if wanted is None else set(wanted)
    for i, (packed, plain, check) in enumerate(table[:-1]):
        if chosen is None or i in chosen:
            ids = unzip.decompress(source.read_at(packed, at), max_output_size=plain)
            if len(ids) != plain or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} is damaged")
            null, key = struct.unpack_from("<?q", keys, 9 * i)
            yield i, None if null else key, start, ids
        at, start = at + packed, start + plain // 4


def write_token_files(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write them in ascending order of doc_id: one row for each file.

    Documents are dealt by ranges of doc_id, so file ``ordinal`` order is document order.  A task
    names its file afresh at each attempt and returns the name; files of lost attempts stay unread.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-frames")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        writer = file = None
        encode = piece_encoder(vocabulary_path)
        end, part = struct.pack("<I", end_id), TaskContext.get().partitionId()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                    store, path = open_fs(file)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = FrameWriter(store.open_output_stream(path, compression=None))
                writer.add(key.as_py(), encode(text.as_py() or "") + end)
        if writer is not None:
            writer.close()
            schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("ordinal", "n_docs", "n_tokens", "first_id", "last_id")), ("nulls", pa.bool_())])
            row = {"file": file, "ordinal": part, "n_docs": len(writer.keys), "n_tokens": writer.tokens, "first_id": writer.first, "last_id": writer.last, "nulls": writer.nulls}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    order = ("doc_id", "_hash", "text")
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange("doc_id", "_hash").sortWithinPartitions(*order).select("doc_id", "text")
    made = f"{folder}/_files"
    dealt.mapInArrow(run, FILES).write.parquet(made)
    return spark.read.schema(FILES).parquet(made)


def read_token_files(files: DataFrame) -> DataFrame:
    """The documents of ``files``; a column ``frames array<int>``, where there is one, says which frames to read."""
    asked = "frames" in files.columns

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("frame", pa.int32()), ("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["file"])
                held, size = [], 0
                with store.open_input_file(path) as source:
                    for frame, key, start, ids in read_frames(source, row.get("frames")):
                        held.append({"file": row["file"], "ordinal": row["ordinal"], "frame": frame, "doc_id": key, "file_start": start, "n_tokens": len(ids) // 4, "ids": ids})
                        size += len(ids)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = files.select("file", "ordinal", *["frames"] * asked)
    return files.repartition(max(1, files.count())).mapInArrow(run, ROWS)  # dealt in turn: a file a task


def file_index(files: DataFrame) -> DataFrame:
    """``(file, ordinal, frame, doc_id)`` of all documents; only the files' tables are read."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("frame", pa.int32()), ("doc_id", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["file"])
                with store.open_input_file(path) as source:
                    _, keys = read_tables(source)
                ids = [None if null else key for null, key in struct.iter_unpack("<?q", keys)]
                for a in range(0, len(ids), 100_000):
                    part = ids[a : a + 100_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n), pa.array([row["ordinal"]] * n), pa.array(range(a, a + n), pa.int32()), pa.array(part, pa.int64())], schema=schema)

    files = files.select("file", "ordinal")
    return files.repartition(max(1, files.count())).mapInArrow(run, "file string, ordinal long, frame int, doc_id long")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``read_token_files``, of the documents of ``wanted(doc_id)`` alone; a null asks for those without an id.

    Files outside the range of the ids wanted stay closed; of the others the tables are read, and then
    the frames that are asked for.
    """
    wanted = wanted.select(F.col("doc_id").cast("long").alias("_wanted")).distinct()
    bounds = wanted.agg(F.min("_wanted").alias("_least"), F.max("_wanted").alias("_most"), F.max(F.col("_wanted").isNull()).alias("_none"))
    may_hold = ((F.col("first_id") <= F.col("_most")) & (F.col("last_id") >= F.col("_least"))) | (F.col("_none") & F.col("nulls"))
    near = files.join(F.broadcast(bounds), may_hold, "left_semi")  # one row
    hit = file_index(near).join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    return read_token_files(hit.groupBy("file", "ordinal").agg(F.collect_list("frame").alias("frames")))


#: Files up to this many are broadcast by their offsets, more are joined by a shuffle.
BROADCAST_FILES = 500_000


def token_documents(files: DataFrame) -> DataFrame:
    """All documents of ``files`` with ``start``: the tokens of all documents before them."""
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = files.select("ordinal", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    if files.count() <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return read_token_files(files).join(offsets, "ordinal").withColumn("start", F.col("file_start") + F.col("_before")).drop("_before")
