"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A flat file is nothing but token ids, little-endian, with an end-of-document id after each document;
ids take two bytes where all fit, else four (``id_bytes``).  ``count_documents`` cuts files into
blocks of equal size; a task searches its block for separators as one array and keeps the lengths
between them.  Files are read once: each block's row, its lengths included, is written.  A document
that began in an earlier block is stitched by a prefix scan over the blocks' summaries, which hold
three numbers each: the separators before a block give its first document's number, the last
separator before it gives that document's beginning.  The scan goes by spans of ``SPAN`` blocks, so
that no task holds all summaries of a large file, and the lengths are joined back to it block by
block.

Tokens after the last separator of a file are a document whose ``ended`` is false.

Nulls and odd input.  ``write_flat_files`` stores a null text as the empty text: no tokens, one
separator.  Rows with null or repeated doc_id are documents of their own.  Empty tables make no
files; empty files give no documents.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import fresh_path, open_fs, stored
from vectide.llm.tokenizing import rank_encoder, read_ranks

#: Tokens of a block; blocks that a task reads, where there are many; blocks that are summed up at once.
BLOCK, BLOCKS_A_TASK, SPAN = 1 << 20, 16, 4096

WRITTEN = "file string, document long, doc_id long, file_bytes long"
BLOCKS = "file string, block long, n_separators long, last long, head long, inner array<long>"


def id_bytes(vocabulary_path: str, end_id: int) -> int:
    """Bytes of an id in flat files of this vocabulary: two, or four where an id needs more than 16 bits."""
    return 2 if max(end_id, *read_ranks(vocabulary_path).values()) < 1 << 16 else 4


def write_flat_files(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)``, of whole-number ids: each partition appends its documents to one file.

    Returns which document of which file each row became; ``file_bytes`` is set on a file's last
    row.  A task names its file afresh at each attempt, so files of lost attempts stay unread.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "flat-tokens")
    kind = f"<u{id_bytes(vocabulary_path, end_id)}"

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("file", pa.string()), ("document", pa.int64()), ("doc_id", pa.int64()), ("file_bytes", pa.int64())])
        out = None
        number = size = 0
        encode, end = rank_encoder(vocabulary_path).encode_to_numpy, np.array([end_id], kind).tobytes()
        last = None
        for batch in batches:
            if out is None and batch.num_rows:
                file = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                store, path = open_fs(file)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None, buffer_size=1 << 20)
            keys = batch.column(0).to_pylist()
            for text in batch.column(1):
                ids = encode(text.as_py() or "").astype(kind).tobytes() + end
                out.write(ids)
                size += len(ids)
            if last is not None:
                yield last
            last = pa.RecordBatch.from_pydict({"file": [file] * len(keys), "document": list(range(number, number + len(keys))), "doc_id": keys, "file_bytes": [None] * len(keys)}, schema=schema) if keys else None
            number += len(keys)
        if out is not None:
            out.close()
            if last is not None:
                yield last.slice(0, last.num_rows - 1)
                tail = last.slice(last.num_rows - 1).to_pylist()
                yield pa.RecordBatch.from_pylist([tail[0] | {"file_bytes": size}], schema=schema)

    made = f"{folder}/_documents"
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WRITTEN).write.parquet(made)
    return spark.read.schema(WRITTEN).parquet(made)


def scan_block(tokens, end_id: int, start: int) -> tuple[int, int | None, int, list[int]]:
    """Separators, place in the file after the last, tokens before the first, lengths between them."""
    import numpy as np

    at = np.flatnonzero(tokens == end_id)
    if not len(at):
        return 0, None, len(tokens), []
    return len(at), start + int(at[-1]) + 1, int(at[0]), (np.diff(at) - 1).tolist()


def count_documents(files: DataFrame, end_id: int, block: int = BLOCK, id_bytes: int = 2) -> DataFrame:
    """``files(file, file_bytes)`` to ``(file, document, n_tokens, ended)``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_separators", pa.int64()), ("last", pa.int64()), ("head", pa.int64()), ("inner", pa.list_(pa.int64()))])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["file"])
                with store.open_input_file(path) as source:
                    tokens = np.frombuffer(source.read_at(id_bytes * block, id_bytes * block * row["block"]), f"<u{id_bytes}")
                n, last, head, inner = scan_block(tokens, end_id, block * row["block"])
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "block": row["block"], "n_separators": n, "last": last, "head": head, "inner": inner}], schema=schema)

    files = files.where(F.col("file_bytes") > 0).select("file", F.expr(f"file_bytes div {id_bytes}").alias("_all"))
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {block}"))).alias("block"))
    n = blocks.count()
    tasks = max(1, min(n, max(4 * blocks.sparkSession.sparkContext.defaultParallelism, n // BLOCKS_A_TASK)))
    found = stored(blocks.repartition(tasks).mapInArrow(run, BLOCKS), "blocks")  # dealt in turn: equal shares

    upto = Window.unboundedPreceding, -1
    summaries = found.select("file", F.expr(f"block div {SPAN}").alias("span"), "block", "n_separators", "last")
    spans = summaries.groupBy("file", "span").agg(F.sum("n_separators").alias("n"), F.max("last").alias("end"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(*upto)
    spans = spans.select("file", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.max("end").over(earlier), F.lit(0)).alias("_end"))
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(*upto)
    summaries = summaries.withColumn("_inside", F.coalesce(F.sum("n_separators").over(before), F.lit(0))).withColumn("_begun", F.max("last").over(before))
    scanned = summaries.join(spans, ["file", "span"]).select("file", "block", (F.col("_n") + F.col("_inside")).alias("_number"), F.coalesce("_begun", "_end").alias("_begun"))
    lengths = F.concat(F.array(F.col("block") * block + F.col("head") - F.col("_begun")), "inner")
    whole = found.where("n_separators > 0").join(scanned, ["file", "block"]).select("file", "_number", F.posexplode(lengths).alias("_k", "n_tokens"))
    whole = whole.select("file", (F.col("_number") + F.col("_k")).alias("document"), "n_tokens", F.lit(True).alias("ended"))
    sums = found.groupBy("file").agg(F.sum("n_separators").alias("document"), F.coalesce(F.max("last"), F.lit(0)).alias("_last"))
    tail = files.join(sums, "file").select("file", "document", (F.col("_all") - F.col("_last")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return whole.unionByName(tail)
