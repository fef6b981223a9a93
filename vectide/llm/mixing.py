"""Mix sources to target weights by Poisson replication.

A source with ``n`` of ``N`` rows and share ``w`` of the target has the mean repetition rate
``w * total / n``.  A row's number of copies is the inverse of the Poisson distribution with that
mean at a uniform number, which a hash of the row's id and text decides; so it is the same at each
run and each retry, and needs no state.  Rows are exploded by their counts and then shuffled
globally: dealt to partitions by a hash of row and copy, and sorted by it.

Weights are given for each source, or follow from the counts: share in proportion to
``n ** (1 / temperature)``.  Sources that given weights don't name get no rows.

Nulls and odd input.  A null source is a source of its own.  A null text counts as empty and a
null id as a value in the hash; such rows are copied like others.  Equal rows get equal counts.
An empty table gives no rows.  Columns of the input pass through; ``copy`` (from 1) and ``copies``
are added, and take the place of columns of these names; names that begin with ``_mix_`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import cleared, joined_by_size, let, stored

#: Source tables up to this many rows are broadcast; of longer ones only the hot sources, the rest meet by a shuffle.
BROADCAST_SOURCES = 10_000


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at first, first + 1, ...: a struct of ``first`` and ``cdf``.  What lies outside is below 1e-20."""
    spread = F.sqrt(rate) * 12 + 30
    first = F.greatest(F.lit(0), F.floor(rate - spread)).cast("long")
    last = F.ceil(rate + spread).cast("long")
    zero = F.lit(0.0)

    def body(p: Column) -> Column:
        logs = F.aggregate(F.when(p["first"] > 0, F.sequence(F.lit(1).cast("long"), p["first"])).otherwise(F.array().cast("array<long>")), zero, lambda a, j: a + F.ln(j.cast("double")))
        start = F.exp(-p.rate + F.when(p["first"] > 0, p["first"] * F.ln(p.rate)).otherwise(zero) - logs)
        state = F.struct(start.alias("p"), start.alias("sum"), F.array(start).alias("out"))
        step = lambda a, j: let(a.p * p.rate / j.cast("double"), lambda q: F.struct(q.alias("p"), (a["sum"] + q).alias("sum"), F.concat(a.out, F.array(a["sum"] + q)).alias("out")))
        return F.struct(p["first"].alias("first"), F.aggregate(F.sequence(p["first"] + 1, p["last"]), state, step, lambda a: a.out).alias("cdf"))

    return let(F.struct(rate.alias("rate"), first.alias("first"), last.alias("last")), body)


def row_unit(seed: int, id_col: str, text_col: str) -> Column:
    """A uniform number in [0, 1) with 52 bits, from the MD5 of seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(text_col, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def mix_sources(df: DataFrame, weights: dict[str | None, float] | None = None, *, temperature: float = 2.0, total: int | None = None, seed: int = 0, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, each as often as drawn, in random order.  ``total``: rows wanted; as many as df has for None."""
    df = cleared(df, "copies", "copy", prefix="_mix_")
    names = df.columns
    counts = stored(df.groupBy(F.col(source_col).alias("_mix_source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("_mix_source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(share)
    counts = counts.select("_mix_source", "n", share.alias("w"))
    sums = counts.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    wanted = F.col("n_all").cast("double") if total is None else F.lit(float(total))
    law = F.when(F.col("w") > 0, poisson_cdf(F.col("w") / F.col("w_all") * wanted / F.col("n")))
    rates = counts.join(F.broadcast(sums)).select("_mix_source", F.col("n").alias("_mix_n"), law.alias("_mix_law"))
    same = F.col(source_col).eqNullSafe(F.col("_mix_source"))
    if counts.count() <= BROADCAST_SOURCES:
        drawn = df.join(F.broadcast(rates), same)
    else:  # the rows of hot sources stay where they are
        drawn = joined_by_size(df, rates, same, "_mix_n", counts.agg(F.sum("n")).first()[0])
    drawn = drawn.where(F.col("_mix_law").isNotNull())
    unit = row_unit(seed, id_col, text_col)
    law = F.col("_mix_law")
    copies = let(unit, lambda u: law["first"] + F.size(F.filter(law["cdf"], lambda c: c <= u)))
    drawn = drawn.withColumn("copies", copies.cast("int")).where("copies > 0")
    out = drawn.select(*names, "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    # with the row's place, so that equal rows don't meet in one task
    key = F.xxhash64(F.lit(seed), F.lit("order"), F.col(id_col), F.col(text_col), F.col("copy"), F.monotonically_increasing_id())
    return out.withColumn("_mix_key", key).repartition("_mix_key").sortWithinPartitions("_mix_key").drop("_mix_key")
