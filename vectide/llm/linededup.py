"""Delete later copies of repeated line runs, found by a suffix array over line ids.

The documents' lines with a word in them form one sequence; a line's id is a 128-bit hash.  Runs
are runs of lines of one document.

1. Lines that occur once end every repeated run, so only the others stay; stretches of them with
   fewer than ``min_words`` words are dropped.  The ids' order statistics are the first ranks.
2. Prefix doubling: a suffix's rank by its first ``2k`` lines is its rank by ``k`` lines, plus the
   suffixes of that rank whose rank ``k`` lines on is smaller.  Pairs of ranks are counted before
   they are sorted within a rank, so a frequent line is many rows only where it has many
   successors.  Suffixes that end first, or have lost their last companion, leave.
3. From each line on, and up to each line, the shortest run of at least ``min_words`` words is an
   interval of suffixes with that common prefix: ranks at its beginning and a power of two before
   its end name it.  A repeated run of enough words is the union of such runs, so together these
   intervals show every maximal repeated run.
4. The first place of each interval stays; all lines of its other places are deleted.  A deleted
   line has an equal line at an earlier place, so each line's first copy stays in the corpus.

Order is by id (nulls first), then by the row's place in the input.

Everything is DataFrame operations; each doubling is written to the shared folder.

Nulls and odd input.  A null text has no lines and stays null.  Lines without words are kept, but
a text whose lines with words are all deleted becomes empty.  Repeated rows are copies of each
other.  An empty table gives no rows.  The input must give its rows in the same order each time it
is read (``stable``: a scan of files with narrow steps on it); other inputs are checkpointed.
Columns pass through; ``n_lines`` and ``n_removed`` are added, and take the place of columns of
these names; names that begin with ``_ld_`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import cleared, let, pin_splits, shared_dir, stored

MIN_WORDS = 50
_WORDS = r"[\x20\x09-\x0D]+"
#: Bits of the ranges of line hashes whose counts are summed up before ranks are given: the least, and
#: the most, of which the sums are 2 ** 20 rows; and the rows of a range.
_RANGES, _MOST_RANGES, _IN_RANGE = 12, 20, 1 << 20
#: Bits of the ranges that the successors of a line are counted in.
_SUCCESSORS = 6


def line_table(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(row, id, at, n, h1, h2)``: lines with words, numbered within their document."""

    def line(x):
        n = F.size(F.array_remove(F.split(x, _WORDS), ""))
        return F.struct(n.alias("n"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))

    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), line), lambda x: x.n > 0)
    return df.select(F.col("_ld_row").alias("row"), F.col(id_col).alias("id"), F.posexplode(lines).alias("at", "x")).select("row", "id", "at", "x.*")


def first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur twice or more, with ``r``: how many such lines have a smaller id."""
    ids = stored(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-ids")
    bits = min(_MOST_RANGES, max(_RANGES, (ids.count() // _IN_RANGE).bit_length()))
    ids = ids.withColumn("range", F.shiftright("h1", 64 - bits))
    sums = ids.groupBy("range").agg(F.sum("c").alias("c"))  # 2 ** bits rows at most
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ids.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(F.broadcast(sums), "range")
    ranked = ranked.select("h1", "h2", (F.col("ahead") + F.col("inside")).alias("r"))
    return lines.join(ranked, ["h1", "h2"]).select("row", "id", "at", "n", "r")


def long_stretches(ranked: DataFrame, min_words: int) -> DataFrame:
    """Lines in stretches of neighbours with enough words, with ``stretch`` and the words before (``s``) and up to the line (``e``)."""
    order = Window.partitionBy("row").orderBy("at")
    whole = Window.partitionBy("row", "stretch")
    up_to = whole.orderBy("at")
    out = ranked.withColumn("stretch", F.col("at") - F.row_number().over(order))
    out = out.withColumn("e", F.sum("n").over(up_to)).withColumn("s", F.col("e") - F.col("n"))
    return out.withColumn("_all", F.sum("n").over(whole)).where(F.col("_all") >= min_words).drop("_all")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``(row, id, at, m)``: for each line the shortest run of enough words from it on, and up to it."""
    whole = Window.partitionBy("row", "stretch")
    later = whole.orderBy("s").rangeBetween(min_words, Window.unboundedFollowing)
    sooner = whole.orderBy("e").rangeBetween(Window.unboundedPreceding, -min_words)
    ends = lines.select(
        "row", "id", "at",
        F.coalesce(F.min("at").over(later) - 1, F.when(F.max("e").over(whole) - F.col("s") >= min_words, F.max("at").over(whole))).alias("last"),
        F.coalesce(F.max("at").over(sooner) + 1, F.when(F.col("e") >= min_words, F.min("at").over(whole))).alias("first"),
    )
    runs = F.array(F.struct(F.col("at"), (F.col("last") - F.col("at") + 1).alias("m")), F.struct(F.col("first").alias("at"), (F.col("at") - F.col("first") + 1).alias("m")))
    return ends.select("row", "id", F.explode(runs).alias("x")).select("row", "id", "x.at", "x.m").where("at is not null and m is not null").distinct()


def doubled(ranks: DataFrame, k: int) -> DataFrame:
    """``ranks(row, at, r)`` by ``k`` lines to those by ``2 * k`` lines, without suffixes that are alone."""
    on = Window.partitionBy("row").orderBy("at").rangeBetween(k, k)
    pairs = ranks.withColumn("r2", F.max("r").over(on)).where("r2 is not null")
    counts = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("c"))
    # a frequent line has many successors: they are counted in ranges of the second rank, and the ranges
    # are summed up first, so that no task sorts all successors of a line
    counts = stored(counts, "rank-pairs")
    span = 1 << max(0, (counts.agg(F.max("r2")).first()[0] or 0).bit_length() - _SUCCESSORS)
    counts = counts.withColumn("range", F.expr(f"r2 div {span}"))
    sums = counts.groupBy("r", "range").agg(F.sum("c").alias("c"))
    earlier = Window.partitionBy("r").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", "range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("r", "range").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    named = counts.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(sums, ["r", "range"])
    named = named.where("c > 1").select("r", "r2", (F.col("r") + F.col("ahead") + F.col("inside")).alias("to"))
    return pairs.join(named, ["r", "r2"]).select("row", "at", F.col("to").alias("r"))


def removed_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(row, gone array<int>)``: which lines of which documents are later copies."""
    kept = stored(long_stretches(first_ranks(lines), min_words), "lines")
    runs = stored(shortest_runs(kept, min_words), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0
    ranks, k, later = kept.select("row", "at", "r"), 1, []
    while k <= longest:
        here = runs.where(F.col("m").between(k, 2 * k - 1))
        ends = ranks.select("row", F.col("at").alias("end"), F.col("r").alias("r2"))
        named = here.join(ranks, ["row", "at"]).withColumn("end", F.col("at") + F.col("m") - k).join(ends, ["row", "end"])
        place = F.struct("id", "row", "at")
        # written, so that the join reads both sides by an exchange and Spark can split a frequent run's rows
        first = stored(named.groupBy("m", "r", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "first-places")
        copies = named.join(first, ["m", "r", "r2"]).where(place != F.col("first"))
        later.append(stored(copies.select("row", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")), "copies"))
        if 2 * k <= longest:
            ranks = stored(doubled(ranks, k), "ranks")
        k *= 2
    if not later:
        return kept.where("false").groupBy("row").agg(F.collect_set("at").alias("gone"))
    found = later[0]
    for more in later[1:]:
        found = found.unionByName(more)
    return found.groupBy("row").agg(F.collect_set("at").alias("gone"))


def dedup_lines(df: DataFrame, *, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id", stable: bool = False) -> DataFrame:
    """df with later copies of repeated line runs cut out of its texts, and ``n_lines`` and ``n_removed`` (lines with words)."""
    df = cleared(df, "n_lines", "n_removed", prefix="_ld_")
    if not stable:
        shared_dir(df.sparkSession)
        df = df.checkpoint()
    pin_splits(df.sparkSession)
    names = df.columns
    df = df.withColumn("_ld_row", F.monotonically_increasing_id())
    gone = removed_lines(stored(line_table(df, text_col, id_col), "all-lines"), min_words)
    joined = df.join(gone.withColumnRenamed("row", "_ld_row").withColumnRenamed("gone", "_ld_gone"), "_ld_row", "left")
    lines = F.split(F.col(text_col), "\n")
    filled = lambda x: F.filter(F.transform(x, lambda y, i: F.when(F.regexp_replace(y, _WORDS, "") != "", i)), lambda i: i.isNotNull())

    def cut(x):
        def without(real):
            gone_at = F.transform("_ld_gone", lambda k: F.get(real, k))
            left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone_at)
            return F.when(F.size("_ld_gone") >= F.size(real), F.lit("")).otherwise(F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n"))

        return let(filled(x), without)

    text = F.when(F.col("_ld_gone").isNull(), F.col(text_col)).otherwise(let(lines, cut))
    counted = F.coalesce(F.size(F.filter(lines, lambda y: F.regexp_replace(y, _WORDS, "") != "")), F.lit(0))
    out = joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], counted.cast("long").alias("n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out
