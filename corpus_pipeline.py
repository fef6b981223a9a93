"""A corpus pipeline over ``documents``, in five stages that the operators of ``vectide.llm`` give.

Each stage takes what the stage before it kept, in the columns of ``documents``; the last gives
the token ids.  ``run`` writes each stage's rows to the shared folder and reads them again, so a
lost executor costs one stage at most.

1. Quality rules: documents that they reject go.
2. Line dedup: later copies of repeated line runs of 50 words or more go; so do documents of which
   nothing is left.
3. SimHash near-dedup: documents whose sets of five-word shingles have a Jaccard similarity of 0.8
   or more are linked, and of each group the document with the smallest id stays.  Fingerprints of
   256 bits choose the candidates: such pairs differ in 39 bits on average, with a deviation of 6,
   texts that share nothing in 128, with a deviation of 8, and candidates in ``RADIUS`` at most.  Each link
   is then tried by the exact similarity.
4. Mixing: each source gets a share in proportion to the root of its rows.
5. Byte-level BPE: ids, and whether they decode to the text.

An empty table gives empty stages.  ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytebpe, linededup, mixing, quality, simhash
from vectide.llm.common import stored
from vectide.llm.tokenizing import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, SIMILARITY, BITS, RADIUS = 5, 0.8, 256, 76


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(docs.select(*COLUMNS), stable=True)
    cut = cut.where("not (n_removed > 0 and n_removed = n_lines)")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    # a row's key: its id, nulls last, then its place in the stage's input
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("_row").alias("row")).alias("key"), "text")
    found = simhash.similar_duplicates(keyed, "text", "key", SHINGLE, SIMILARITY, RADIUS, BITS // 64)
    first = found.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("_row"))
    return docs.join(first, "_row", "left_semi").select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*COLUMNS), temperature=2.0, seed=9).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bytebpe.Vocabulary(spark, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bytebpe.encode(docs.select("doc_id", "source", "text"), vocab)
    decoded = bytebpe.decode(encoded, vocab)
    intact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL has no way to express the fingerprints' components nor the merges; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
