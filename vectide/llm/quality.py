"""Quality rules by distribution divergence.

Each document has two histograms: of its characters by class, and of common words of its language.
The references are the sums of the histograms over all documents of a language.  A document is
rejected where the Jensen-Shannon distance (base 2, from 0 to 1) of either histogram to its
language's reference is over a limit.

The limits follow from how far a sample of ``n`` words strays from the distribution that it is drawn
from: the divergence of a histogram of ``k`` counts is about chi-square with ``k - 1`` degrees of
freedom over ``8 n ln 2``.  ``stray`` is the distance of its mean plus ``SIGMAS`` deviations.  Words
may stray that far and, independently, ``WORD_MARGIN``; characters, which come word by word, that far
beyond ``CHAR_MARGIN``.  So short texts have wide limits and long ones narrow limits, and below
``MIN_WORDS`` words the distances don't count.

The base rules reject a text of fewer than 20 words, and one of which over 30 % of the words lie
in 8-word windows that the text holds twice or more.  Windows are told apart by 64-bit hashes, and
those whose hashes meet are compared word by word.

Everything is a DataFrame expression.  Words are what ``[^\\x20\\x09-\\x0D]+`` matches.

Nulls and odd input.  A null text has no words and no lines, and is rejected.  A null language is a
language of its own; one without a list of common words uses all lists.  Repeated rows are judged
alike.  Empty tables give no rows.  Columns of the input pass through; those that are named like
the ``ADDED`` ones are replaced, and names that begin with ``_q_`` are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import cleared, let, stored

#: Common function words of the languages that references are kept for.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not this but are or from at which".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur par plus ne pas au avec elle ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
ALL_WORDS = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))

MIN_WORDS = 40
SIGMAS = 3.0
WORD_MARGIN, CHAR_MARGIN = 0.10, 0.13
WINDOW = 8
CLASSES = 7
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
#: Reference tables up to this many languages are broadcast, longer ones joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more; ``window`` is a power of two.

    The words are bound once: a plan may put their expression wherever their column stands.
    """
    return let(words, lambda ws: _repeated_words(ws, window))


def _repeated_words(words: Column, window: int) -> Column:
    def twice(keyed: Column) -> Column:
        """Of structs (h, i) those whose ``h`` occurs twice or more."""
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x.h, F.lit(False))
        return let(F.sort_array(keyed), lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))

    def covered(found: Column) -> Column:
        hashed = twice(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spelled = F.transform(hashed, lambda x: F.struct(F.concat_ws(" ", *[F.get(words, x.i + k) for k in range(window)]).alias("h"), x.i.alias("i")))

        def runs(s: Column) -> Column:
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct((i + window).alias("end"), (a.n + window - F.greatest(F.lit(0), a.end - i)).alias("n"))
            return F.aggregate(F.sort_array(F.transform(s, lambda x: x.i)), start, step, lambda a: a.n)

        return let(twice(spelled), runs)

    def joined(k: int):
        """From hashes of ``k`` words to hashes of twice as many: each joined to the one ``k`` words on."""
        rest = lambda h: F.greatest(F.size(h) - k, F.lit(0))
        return lambda h: F.zip_with(F.slice(h, 1, rest(h)), F.slice(h, k + 1, rest(h)), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for level in range(window.bit_length() - 1):
        hashes = let(hashes, joined(1 << level))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with ``_q_words`` and the base counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, _SPACES, "") != "")
    df = df.withColumn("_q_words", words_of(F.col(text_col)))
    df = df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_q_words")).cast("long"),
    })
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def histograms(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """df (with ``_q_words``) with ``_q_chars`` and ``_q_common``: counts in fixed order, the rest last."""
    rest = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[a-z\x20\x09-\x0D]+", "")
    less = lambda s, pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    classes = [r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\"()-]+", _SYMBOLS, r"[ß-ÿ]+"]

    def by_class(s: Column) -> Column:
        counts = F.array(F.length(F.array_join("_q_words", "")) - F.length(s), *[less(s, p) for p in classes])
        return let(counts, lambda c: F.concat(c, F.array(F.length(F.array_join("_q_words", "")) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))

    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        listed = F.when(F.col(lang_col) == lang, F.array(*map(F.lit, words))).otherwise(listed)
    listed = F.coalesce(listed, F.array(*map(F.lit, ALL_WORDS)))

    def by_word(found: Column) -> Column:
        counts = F.transform(listed, lambda w: F.size(found) - F.size(F.array_remove(found, w)))
        return let(counts, lambda c: F.concat(c, F.array(F.size("_q_words") - F.aggregate(c, F.lit(0), lambda a, x: a + x))))

    common = F.filter("_q_words", lambda w: w.isin(ALL_WORDS))
    return df.withColumns({"_q_chars": let(rest, by_class), "_q_common": let(common, by_word)})


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts."""
    share = lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: F.transform(c, lambda x: x / F.greatest(n, F.lit(1.0))))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(counts), share(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def stray(k: Column, n: Column) -> Column:
    """The squared distance that a histogram of ``k`` counts over ``n`` words may have by chance."""
    return (k - 1 + SIGMAS * F.sqrt(2.0 * (k - 1))) / (n * (8 * math.log(2)))


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``_q_lang`` and its summed histograms ``_q_ref_chars`` and ``_q_ref_common``, over all documents."""
    hists = histograms(df.select(text_col, lang_col).withColumn("_q_words", words_of(F.col(text_col))), text_col, lang_col)
    both = hists.select(F.col(lang_col).alias("_q_lang"), F.posexplode(F.concat("_q_chars", "_q_common")).alias("_q_at", "_q_n"))
    sums = both.groupBy("_q_lang", "_q_at").agg(F.sum("_q_n").alias("_q_n"))
    arrays = sums.groupBy("_q_lang").agg(F.sort_array(F.collect_list(F.struct("_q_at", "_q_n"))).alias("_q_all"))
    values = F.transform("_q_all", lambda x: x._q_n)
    return arrays.select("_q_lang", F.slice(values, 1, CLASSES).alias("_q_ref_chars"), F.slice(values, CLASSES + 1, F.size(values) - CLASSES).alias("_q_ref_common"))


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """df with the counts, ``base_failed``, both distances (null below MIN_WORDS words) and ``kept``."""
    df = cleared(df, *ADDED, prefix="_q_")
    names = df.columns
    refs = stored(references(df, text_col, lang_col), "quality-references") if refs is None else refs
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    scored = histograms(base_counts(df, text_col), text_col, lang_col)
    scored = scored.join(refs, F.col(lang_col).eqNullSafe(F.col("_q_lang")), "left")
    enough = F.col("n_words") >= MIN_WORDS
    scored = scored.withColumns({
        "char_distance": F.when(enough, distance(F.col("_q_chars"), F.col("_q_ref_chars"))),
        "word_distance": F.when(enough, distance(F.col("_q_common"), F.col("_q_ref_common"))),
    })
    char_limit = CHAR_MARGIN + F.sqrt(stray(F.size("_q_chars"), F.col("n_words")))
    word_limit = F.sqrt(WORD_MARGIN**2 + stray(F.size("_q_common"), F.col("n_words")))
    far = (F.col("char_distance") > char_limit) | (F.col("word_distance") > word_limit)
    scored = scored.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return scored.select(*names, *ADDED)
