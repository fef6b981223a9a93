"""Ranked lexical search with block-max pruning.

``build_index`` takes each partition's documents in runs, puts a run in order of the documents' most
frequent terms and lengths, so that neighbours share terms, and cuts it into blocks.  A row of the
index is a block: its distinct terms; for each term the largest impact ``10^9 tf div (1000 tf + 8 m)``
that any of its documents gives (the block's maximum) and the number of documents that hold it; and
the forward index, which is each document's terms and their frequencies.  Terms are one string with
spaces between, and all numbers but the maxima are packed in as few bytes as a block's largest
takes: of arrays, Spark's readers hold levels, offsets and elements, several times the memory.

``search`` goes in two rounds.  First the maxima bound each block's best score for each query; the
blocks with the highest bounds, ``SEEDS`` a query, are scored by the forward index, and their k-th
best score is the query's threshold.  Then each task bounds its blocks again, sorts a query's blocks
by bound and scores them until the bound drops below the threshold, which rises with what the task
finds.  A bound equal to the threshold is still scored, because a smaller id may win the tie.  So
the result is exact.  Blocks stay where they are; only the few seeds are joined, by a broadcast.

Queries go in portions of about ``QUERY_BYTES`` of text, each of which is sent to all tasks; a
portion's terms, seeds and thresholds are all that the driver sees.  A term that all documents hold
is one number a block, so nothing is skewed, and what leaves a task is k rows a query.

Nulls and odd input.  A null text, or one without a term, is in no block and doesn't count in N.
Documents with a null id are ranked, after others of the same score.  Repeated rows are documents of
their own.  A query without terms, or with terms that no document holds, has no rows; queries with
the same id are ranked apart.  A block closes at ``BLOCK_DOCS`` documents, a run at ``RUN_POSTINGS``
terms; a very long text is a run by itself.  Empty tables give no rows.  Only the named columns are
read, so others can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectide.llm.common import stored

#: Documents of a block; distinct terms by document that a task puts in order at once.
BLOCK_DOCS, RUN_POSTINGS = 16, 1 << 18
#: Blocks that are scored for each query to find its threshold.
SEEDS = 4
#: Bytes of query texts that are answered in one pass.
QUERY_BYTES = 4_000_000
#: Blocks that a task sorts and scores together.
_TOGETHER = 128

#: Bytes to terms: A-Z in lower case, other ASCII than letters and digits to spaces, the rest as it is.
_LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


@dataclass(frozen=True)
class Index:
    """Blocks, the number of documents with a term, and all their terms; a larger corpus needs a new index."""

    blocks: DataFrame
    documents: int
    length: int


def _impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The integer part of a score that a term gives, without its weight; n: the terms of the document of each tf."""
    m = 25 + 75 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Index:
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("terms", T.BinaryType()),
        T.StructField("lengths", T.ArrayType(T.LongType(), False)), T.StructField("ends", T.ArrayType(T.IntegerType(), False)), T.StructField("at", T.BinaryType()), T.StructField("tf", T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa

        arrow, made, held, postings = to_arrow_schema(schema), TaskContext.get().partitionId() << 33, [], 0
        known: dict[bytes, int] = {}  # a run's terms; its documents hold their numbers, as a dictionary each would take many times the memory

        def blocks():
            nonlocal made
            held.sort(key=lambda h: h[0])
            names = list(known)
            for i in range(0, len(held), BLOCK_DOCS):
                part = held[i : i + BLOCK_DOCS]
                words, at = np.unique(np.concatenate([n for *_, n, _ in part]), return_inverse=True)
                columns = [
                    made, [i for _, i, *_ in part], b" ".join([names[w] for w in words.tolist()]), [int(tf.sum()) for *_, tf in part],
                    np.cumsum([len(tf) for *_, tf in part]).astype(np.int32), _packed(at), _packed(np.concatenate([tf for *_, tf in part])),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, arrow)], schema=arrow)
                made += 1
            held.clear()
            known.clear()

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                found = _counted(text.as_py(), known)
                if found is None:
                    continue
                order, numbers, tf = found
                held.append((order, i.as_py(), numbers, tf))
                postings += len(tf)
                if postings >= RUN_POSTINGS:
                    yield from blocks()
                    postings = 0
        if held:
            yield from blocks()

    forward = stored(rows.mapInArrow(run, schema), "forward-index")
    sums = forward.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("l")).first()
    documents, length = sums.n, sums.l

    names = forward.columns

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            lengths, ends, at, tf = (batch.column(names.index(c)) for c in ("lengths", "ends", "at", "tf"))
            most, df = [], []
            for i in range(batch.num_rows):
                until = _flat(ends, i)
                where = _unpacked(at, i, until[-1])
                impact = _impacts(_unpacked(tf, i, until[-1]).astype(np.int64), np.repeat(_flat(lengths, i), np.diff(until, prepend=0)), documents, length)
                held = np.bincount(where)  # a document holds each term once, and some document each term
                top = np.zeros(len(held), np.int64)
                np.maximum.at(top, where, impact)
                most.append(top.astype(np.int32))
                df.append(_packed(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(most, pa.list_(pa.int32())), pa.array(df, pa.binary())], names=[*names, "most", "df"])

    both = T.StructType([*schema.fields, T.StructField("most", T.ArrayType(T.IntegerType(), False)), T.StructField("df", T.BinaryType())])
    return Index(stored(forward.mapInArrow(bound, both), "lexical-blocks"), documents, length)


def _counted(text: bytes, known: dict[bytes, int]) -> tuple | None:
    """A text's place in a run, and its terms, as numbers of the run's ``known`` ones, with their frequencies; nothing without a term."""
    counts = Counter(terms(text))
    if not counts:
        return None
    numbers = np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts))
    return (min((-n, t) for t, n in counts.items())[1], counts.total()), numbers, np.fromiter(counts.values(), np.int32, len(counts))


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest takes."""
    return values.astype(np.min_scalar_type(values.max()).newbyteorder("<")).tobytes()


def _unpacked(column, i: int, n: int) -> np.ndarray:
    """The n packed numbers of row i."""
    packed = column[i].as_buffer()
    return np.frombuffer(packed, f"<u{packed.size // n}")


def _flat(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


class _Portion:
    """A portion of queries: each one's terms as numbers of the portion's vocabulary, with their weights once they are known."""

    def __init__(self, rows: list):
        parsed = [(r.place, c) for r in rows if (c := Counter(terms(bytes(r.text))))]
        self.places = [p for p, _ in parsed]
        self.number: dict[bytes, int] = {}
        self.term = [np.array([self.number.setdefault(t, len(self.number)) for t in c], np.int64) for _, c in parsed]
        self.times = [np.array(list(c.values()), np.int64) for _, c in parsed]

    def weigh(self, df: dict[int, int], documents: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(self.number))], np.int64)
        self.weights = [n * w[t] for t, n in zip(self.term, self.times)]
        self.flat_term, self.flat_weight = np.concatenate(self.term), np.concatenate(self.weights)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.term])[:-1]])

    def numbers(self, words) -> list[np.ndarray]:
        """The numbers of the terms of each block of a column, -1 for a term that no query has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.split_pattern(words, b" ")
        found = pc.fill_null(pc.index_in(words.values, value_set=pa.array(list(self.number), words.type.value_type)), -1).to_numpy(zero_copy_only=False)
        ends = words.offsets.to_numpy().tolist()
        return [found[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def bounds(self, numbers: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The largest score that a document of the block may have, for each query."""
        top = np.zeros(len(self.number), np.int64)
        known = numbers >= 0
        top[numbers[known]] = most[known]
        return np.add.reduceat(self.flat_weight * top[self.flat_term], self.starts)


class _Best:
    """The k best documents of each query so far: highest score, then smallest id, nulls last."""

    def __init__(self, k: int, least: list[int]):
        self.k, self.least, self.rows = k, list(least), [[] for _ in least]

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        hits = np.flatnonzero(scores >= self.least[q])
        if len(hits):
            rows = self.rows[q] + [(-int(scores[i]), ids[i] is None, 0 if ids[i] is None else ids[i]) for i in hits.tolist()]
            rows.sort()
            self.rows[q] = rows[: self.k]
            if len(self.rows[q]) == self.k:
                self.least[q] = max(self.least[q], -self.rows[q][-1][0])


def _scored(blocks: list[tuple], portion: _Portion, best: _Best, documents: int, length: int) -> None:
    """Score blocks ``(numbers, ids, lengths, ends, at, tf, queries, bounds)`` for their queries, the highest bounds first."""
    order: dict[int, list[tuple[int, int]]] = {}
    for b, block in enumerate(blocks):
        for q, bound in zip(block[6].tolist(), block[7].tolist()):
            order.setdefault(q, []).append((bound, b))
    ready: dict[int, tuple] = {}
    for q, ranked in order.items():
        weight = np.zeros(len(portion.number), np.int64)
        weight[portion.term[q]] = portion.weights[q]
        for bound, b in sorted(ranked, reverse=True):
            if bound < best.least[q]:
                break
            if b not in ready:
                ready[b] = _postings(blocks[b], documents, length)
            number, impact, ends, ids = ready[b]
            so_far = np.concatenate([[0], np.cumsum(weight[number] * impact)])[ends]
            best.add(q, so_far[1:] - so_far[:-1], ids)


def _postings(block: tuple, documents: int, length: int) -> tuple:
    """A block's postings of the queries' terms: numbers, impacts, the documents' ends among them, ids."""
    numbers, ids, lengths, ends, at, tf = block[:6]
    number, doc = numbers[at], np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
    kept = number >= 0
    impact = _impacts(tf[kept].astype(np.int64), lengths[doc[kept]], documents, length)
    return number[kept], impact, np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(ids)))]), ids


def _found(index: Index, portion: _Portion, k: int, least: list[int], seeds: DataFrame | None = None, done: dict[int, list[int]] | None = None) -> DataFrame:
    """``(place, id, score)``: each task's k best; the number of rows is bounded by tasks and queries.

    Of the blocks of ``seeds(block, queries, bounds)``; or of all blocks whose bounds reach ``least``,
    but for those that ``done`` has for a query.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = ["block", "terms", "ids", "lengths", "ends", "at", "tf"]
    blocks = index.blocks.select(*columns, "most") if seeds is None else index.blocks.select(*columns).join(F.broadcast(seeds), "block").select(*columns, "queries", "bounds")
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("id", index.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    documents, length, whole = index.documents, index.length, seeds is None

    def run(batches):
        import pyarrow as pa

        best = _Best(k, least)
        for batch in batches:
            names, words, ids, lengths, ends, at, tf = (batch.column(c) for c in range(7))
            numbers, rest = portion.numbers(words), [batch.column(c) for c in range(7, batch.num_columns)]
            for i in range(0, batch.num_rows, _TOGETHER):
                part = []
                for j in range(i, min(i + _TOGETHER, batch.num_rows)):
                    if whole:
                        bound = portion.bounds(numbers[j], _flat(rest[0], j))
                        asking = bound >= np.array(best.least, np.int64)
                        asking[(done or {}).get(names[j].as_py(), [])] = False
                        queries = np.flatnonzero(asking)
                        bounds = bound[queries]
                    else:
                        queries, bounds = _flat(rest[0], j), _flat(rest[1], j)
                    if len(queries):
                        until = _flat(ends, j)
                        part.append((numbers[j], ids[j].as_py(), _flat(lengths, j), until, _unpacked(at, j, until[-1]), _unpacked(tf, j, until[-1]), queries, bounds))
                _scored(part, portion, best, documents, length)
        rows = [(portion.places[q], None if none else i, -score) for q, found in enumerate(best.rows) for score, none, i in found]
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, arrow)], schema=arrow)

    return blocks.mapInArrow(run, schema)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _portion_rows(index: Index, portion: _Portion, k: int) -> DataFrame:
    """``(place, id, score, rank)`` of one portion of queries."""

    def count(batches):
        import pyarrow as pa

        df = np.zeros(len(portion.number), np.int64)
        for batch in batches:
            for i, numbers in enumerate(portion.numbers(batch.column(0))):
                known, found = numbers >= 0, _unpacked(batch.column(1), i, len(numbers))
                df[numbers[known]] += found[known]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    counted = index.blocks.select("terms", "df").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    portion.weigh({r.term: r.df for r in counted.collect()}, index.documents)

    def seed(batches) -> Iterator:
        import pyarrow as pa

        tops: list[list[tuple[int, int]]] = [[] for _ in portion.places]
        for batch in batches:
            for i, (block, numbers) in enumerate(zip(batch.column(0).to_pylist(), portion.numbers(batch.column(1)))):
                bounds = portion.bounds(numbers, _flat(batch.column(2), i))
                for q in np.flatnonzero(bounds).tolist():
                    if len(tops[q]) < SEEDS or bounds[q] > tops[q][-1][0]:
                        tops[q] = sorted([*tops[q], (int(bounds[q]), block)], reverse=True)[:SEEDS]
        rows = [(q, bound, block) for q, top in enumerate(tops) for bound, block in top]
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["query", "bound", "block"])

    tops = index.blocks.select("block", "terms", "most").mapInArrow(seed, "query int, bound long, block long")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block")) <= SEEDS
    seeds = stored(tops.withColumn("first", first).where("first"), "seeds")  # SEEDS rows a query of the portion at most
    asked = seeds.groupBy("block").agg(F.collect_list("query").alias("queries"), F.collect_list("bound").alias("bounds"))
    nothing = [1] * len(portion.places)
    found = stored(_best_of(_found(index, portion, k, nothing, asked), k), "seed-rows")
    number = {p: q for q, p in enumerate(portion.places)}
    least = list(nothing)
    for r in found.groupBy("place").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect():
        least[number[r.place]] = r.score
    done: dict[int, list[int]] = {}
    for r in seeds.select("block", "query").collect():
        done.setdefault(r.block, []).append(r.query)
    return _best_of(found.drop("rank").unionByName(_found(index, portion, k, least, done=done)), k)


def search(index: Index, queries: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "item_id", doc_col: str = "doc_id") -> DataFrame:
    """``(id_col, rank, doc_col, score)``: each query's k documents of the highest score above 0."""
    asked = queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("place"))
    asked = stored(asked.where("text is not null"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    portions = -(-size // QUERY_BYTES)
    rows = None
    for p in range(portions):
        # dealt by a hash, so a portion is about QUERY_BYTES, or one text
        portion = _Portion(asked.where(F.pmod(F.xxhash64("place"), F.lit(portions)) == p).select("place", "text").collect())
        if portion.places:
            part = stored(_portion_rows(index, portion, k), "ranked")
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
        rows = asked.where("false").selectExpr("place", f"cast(null as {kind}) as id", "cast(null as long) as score", "cast(null as int) as rank")
    return rows.join(asked.select("place", "item"), "place").select(F.col("item").alias(id_col), "rank", F.col("id").alias(doc_col), "score")
