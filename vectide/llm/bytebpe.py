"""Byte-level BPE in Spark expressions: encode by folding ranked merges, decode by joining pieces.

A text is cut by the tokenizer's pattern.  A piece that is a token is that token; any other is
folded: of all neighbours whose join is a token, the pair with the lowest rank, the leftmost of
equals, is joined, until none is left.  The fold is ``aggregate`` over the piece's bytes; its state
is one array of the parts' ids with, between neighbours, the rank of their join, which is its id.

Ranks are a literal map from pairs of ids: every way to cut a token into two.  It is an array of
small maps, so that a lookup does not search 200,000 keys.  Literals reach the plan as a scalar
subquery in a column that one expression uses; the optimizer puts it in there, so no row holds it.

Pieces repeat, so distinct ones are folded once where that pays: the tokens and the ``WORDS`` most
frequent pieces of about ``SAMPLE`` documents form a second literal of the same kind, and the
``FEW`` most frequent a third that fits a processor's cache.  They have fixed bounds; pieces that
they lack are folded where they stand, so they never decide a result.

An ``aggregate`` copies its state at each step, so it costs the square of a piece's length.  So a
text with pieces of more than ``LONG`` bytes, as prose has none, is marked, and encoded by the same
rule in Arrow batches, with a heap of the joins (``fold_long``).

Nulls and odd input.  A null text is the empty text, which has no ids.  Long texts and long pieces
are taken whole.  Vocabularies of any size are taken.  Repeated rows are encoded alike.
An empty table gives no rows.  Unknown ids make ``decode`` null.  Columns of the input pass
through; those that are named like the added one, or ``_bpe``, are replaced or dropped.
"""

from __future__ import annotations

import contextlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import cleared, let, stored
from vectide.llm.tokenizing import read_ranks

SAMPLE = 30_000
WORDS = 400_000
FEW = 8_000
_BUCKETS, _FEW_BUCKETS = 1 << 17, 1 << 13

#: Unicode's white space, which Java's own class has only in part.
_SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]")


def find(table: Column, piece: Column, buckets: int = _BUCKETS) -> Column:
    """The ids of ``piece`` in an array of maps by its hash, or null."""
    return F.try_element_at(F.get(table, _bucket(piece, buckets)), piece)


def _bucket(piece: Column, buckets: int) -> Column:
    return F.hash(piece).bitwiseAND(buckets - 1)


def _table(spark: SparkSession, ids: DataFrame, buckets: int, name: str) -> DataFrame:
    """One row: ``ids(w, ids)`` as an array of maps by hash."""
    maps = ids.groupBy(_bucket(F.col("w"), buckets).alias("b")).agg(F.collect_list(F.struct("w", "ids")).alias("m"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    none = F.array().cast("array<struct<w:string,ids:array<int>>>")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("m", none).alias("m")))).alias("all"))
    return rows.select(F.transform("all", lambda x: F.map_from_entries(x.m)).alias(name))


#: Parts' ids are kept this much higher than ranks, so that the least number of a state is a rank.
#: This for ids of 16 bits; larger vocabularies take a larger power of two.
_PART = 1 << 16
#: Odd, so that of the pairs in a bucket no two have the same second id.
_SPREAD = 16_381
#: Pieces of more bytes go to ``fold_long``.
LONG = 256


def pair_bucket(a, b, part: int = _PART):
    """Where the pair of two parts is kept (columns, or numbers in Python)."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a * _SPREAD + b & (part - 1)
    if part > _PART:
        return (a.cast("long") * _SPREAD + b.cast("long")).bitwiseAND(part - 1).cast("int")
    return (a * _SPREAD + b).bitwiseAND(part - 1)


class Vocabulary:
    """The literals of a rank file, and its pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.spark, self.pattern, self.plain_pattern = spark, java_pattern(pattern), pattern
        self.path = path
        self.part = part = max(_PART, 1 << (max(ranks.values(), default=0) + 1).bit_length())
        pairs: list[dict[int, int]] = [{} for _ in range(part)]
        pieces = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.hex().upper()
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[pair_bucket(a, b, part)][b + part] = rank
        single = [ranks[bytes([b])] + part for b in range(256)]
        self.size = len(pieces) if None not in pieces else 0
        tokens = {}
        for token, rank in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):  # pieces are whole characters
                tokens[token.decode()] = rank
        source = spark.createDataFrame([(json.dumps(pairs), json.dumps(pieces), json.dumps(tokens), single)], "pairs string, pieces string, tokens string, bytes array<int>").coalesce(1)
        maps = F.transform(F.from_json("pairs", "array<map<string,int>>"), lambda m: F.transform_keys(m, lambda k, _: k.cast("int")))
        self.literals = stored(source.select(F.struct(maps.alias("pairs"), "bytes").alias("merges"), F.transform(F.from_json("pieces", "array<string>"), lambda p: F.unhex(p)).alias("pieces"), F.from_json("tokens", "map<string,int>").alias("tokens")), "bpe-vocabulary")

    def merges(self) -> Column:
        return self.literals.select("merges").scalar()

    def pieces(self) -> Column:
        """The bytes of each token, as strings, which may hold parts of characters."""
        return self.literals.select(F.transform("pieces", lambda p: p.cast("string"))).scalar()

    def tokens(self) -> DataFrame:
        """``(w, ids)`` of each token that is a string."""
        return self.literals.select(F.explode("tokens").alias("w", "id")).select("w", F.array("id").alias("ids"))


def with_literal(df: DataFrame, literal: Column, name: str, body) -> DataFrame:
    """df with the column ``name``: ``body(literal)``, where body uses the literal once."""
    df = cleared(df, "_bpe", name)
    return df.withColumn("_bpe", literal).withColumn(name, let(F.col("_bpe"), body)).drop("_bpe")


def fold(merges: Column, word: Column, part: int = _PART) -> Column:
    """The ids of a piece of two bytes or more that is no token; ``part`` is the vocabulary's."""
    edge = 2 * part - 1  # no id: what stands before the first part and behind the last
    rank = lambda a, b: F.try_element_at(F.get(merges.pairs, pair_bucket(a, b, part)), b)

    def begin(parts: Column) -> Column:
        """An edge, and before each part the rank of its join to the part before; nulls where there is none."""
        pairs = F.flatten(F.transform(parts, lambda b, i: F.array(rank(F.get(parts, i - 1), b), b)))
        return F.flatten(F.array(F.array(F.lit(edge)), pairs, F.array(F.lit(None).cast("int"), F.lit(edge))))

    def step(x: Column, _: Column) -> Column:
        def join(m: Column) -> Column:
            def at(p: Column) -> Column:
                """``p``: where the rank stands, from 1; parts beside it become one."""
                new = F.array(rank(F.get(x, p - 4), m + part), m + part, rank(m + part, F.get(x, p + 2)))
                return F.flatten(F.array(F.slice(x, 1, p - 3), new, F.slice(x, p + 3, F.size(x))))

            return F.when(m < part, let(F.array_position(x, m).cast("int"), at)).otherwise(x)

        return let(F.array_min(x), join)

    finish = lambda x: F.transform(F.filter(x, lambda v: (v >= part) & (v < edge)), lambda v: v - part)
    letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    parts = F.transform(letters, lambda c: F.get(merges.bytes, F.ascii(c)))
    return F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), let(parts, begin), step, finish)


def fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What ``fold`` gives, by a heap of the joins: the lowest rank first, the leftmost of equals."""
    import heapq

    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place
    joins: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and (b := end[a]) < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(joins, (rank, a, b, end[b]))

    for a in range(n):
        offer(a)
    gone = bytearray(n + 1)
    while joins:
        _, a, b, c = heapq.heappop(joins)
        if gone[a] or gone[b] or end[a] != b or end[b] != c:
            continue
        end[a], gone[b] = c, 1
        before[c] = a
        offer(a)
        offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


_ranks: dict[str, dict[bytes, int]] = {}


def _encoded_by_heap(path: str, pattern: str):
    """An expression from texts to their ids; nulls stay null."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        import regex

        if path not in _ranks:
            _ranks[path] = read_ranks(path)
        ranks = _ranks[path]

        def ids(piece: bytes) -> list[int]:
            known = ranks.get(piece)
            return fold_long(piece, ranks) if known is None else [known]

        return texts.map(lambda t: None if t is None else [i for w in regex.findall(pattern, t) for i in ids(w.encode())])

    return encoded


def split_words(vocabulary: Vocabulary, text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(vocabulary.pattern), F.lit(0))


def frequent_words(vocabulary: Vocabulary, docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables of one row, ``words`` and ``few``: the ids of all tokens and of a sample's most frequent pieces, and those of the first of them."""
    n = docs.count()
    some = docs.select(text_col) if n <= SAMPLE else docs.select(text_col).sample(SAMPLE / n, seed=1)
    counts = some.select(F.explode(split_words(vocabulary, F.col(text_col))).alias("w")).where(F.octet_length("w") <= LONG).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    tokens = vocabulary.tokens()
    top = counts.orderBy(F.desc("n"), "w").limit(WORDS).join(tokens.withColumnRenamed("ids", "token"), "w", "left").repartition(F.col("w"))
    ids = with_literal(top, vocabulary.merges(), "ids", lambda m: F.coalesce("token", fold(m, F.col("w"), vocabulary.part))).select("w", "n", "ids")
    ids = stored(ids, "bpe-pieces")
    words = ids.select("w", "ids").unionByName(tokens.join(ids, "w", "left_anti"))
    few = ids.orderBy(F.desc("n"), "w").limit(FEW).select("w", "ids")
    spark = vocabulary.spark
    return stored(_table(spark, words, _BUCKETS, "words"), "bpe-words"), stored(_table(spark, few, _FEW_BUCKETS, "few"), "bpe-few")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of each text."""
    words, few = frequent_words(vocabulary, docs, text_col)
    literals = F.struct(vocabulary.merges().alias("merges"), words.scalar().alias("words"), few.scalar().alias("few"))

    marked = F.array(F.lit(-1))

    def ids(g: Column) -> Column:
        rest = lambda w: F.when(F.octet_length(w) > LONG, marked).otherwise(fold(g.merges, w, vocabulary.part))
        piece = lambda w: F.coalesce(find(g.few, w, _FEW_BUCKETS), find(g.words, w), rest(w))
        return F.flatten(F.transform(split_words(vocabulary, F.col(text_col)), piece))

    encoded = with_literal(docs, literals, ids_col, ids)
    long = F.when(F.array_min(ids_col) < 0, F.col(text_col))
    return encoded.withColumn(ids_col, F.coalesce(_encoded_by_heap(vocabulary.path, vocabulary.plain_pattern)(long), F.col(ids_col)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""


    def bytes_of(pieces: Column) -> Column:
        text = F.array_join(F.transform(ids_col, lambda i: F.get(pieces, i)), "").cast("binary")
        if vocabulary.size:
            known = F.coalesce((F.array_min(ids_col) >= 0) & (F.array_max(ids_col) < vocabulary.size), F.lit(True))
        else:
            known = ~F.exists(ids_col, lambda i: F.get(pieces, i).isNull())
        return F.when(known, text)

    return with_literal(df, vocabulary.pieces(), bytes_col, bytes_of)
