"""Queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can give the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bytebpe, exactdedup, flatscan, lexical, linededup, media, mixing, pii, quality, seekable, sharding, simhash, vectorcodes
from vectide.llm.common import stored, table
from vectide.llm.tokenizing import vocabulary

#: The free id after the ranks of the rank files.
RANK_END = 50256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = media.texts_to_avi(docs).drop("text")
    read = media.avi_clips(made)
    cuts = F.array_join(F.transform("clips", lambda c: c.start_frame.cast("string")), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), "frames", F.lit(";shots="), F.size("clips"), F.lit(";starts="), cuts).alias("feature"),
    )


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    written = flatscan.write_flat_files(table(spark, sf_dir, "documents"), ranks, RANK_END)
    files = written.where("file_bytes is not null").select("file", "file_bytes")
    counts = flatscan.count_documents(files, RANK_END, id_bytes=flatscan.id_bytes(ranks, RANK_END))
    return written.join(counts, ["file", "document"], "left").select("doc_id", "n_tokens", "ended")


@query
def op7_token_id_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = seekable.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)
    return seekable.token_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), 16, seed=1, stable=True)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=2.0, seed=9)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang").withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


@query
def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bytebpe.Vocabulary(spark, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab).drop("text")
    return bytebpe.decode(encoded, vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stored(simhash.fingerprints(docs, "text", width=4), "simhash")
    found = simhash.near_duplicates(prints, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("words", 1)), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, min_words=linededup.MIN_WORDS, stable=True)


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = pii.tag(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s.base)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.size(F.filter(base, _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    more = [F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added")]
    return tagged.select("doc_id", *counts, F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)


def _is(kind: str):
    return lambda s: s.kind == F.lit(kind)


@query
def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    numbers = stored(vectorcodes.scaled(vectors, "embedding", parts=16, scale=256), "scaled-vectors")
    books = vectorcodes.fit(numbers, "vec_id", parts=16, entries=64, rounds=2)
    coded = vectorcodes.label_errors(vectorcodes.encode(numbers, books), "label")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).cast("string").alias("codebooks_sha256"))


@query
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=10)


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op9_mixing_sources"] = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) / sum(pow(n::DOUBLE, 0.5)) OVER () * sum(n) OVER ()::DOUBLE / n AS rate FROM counts),
laws AS (
  SELECT source, list_transform(range(0, ceil(rate + sqrt(rate) * 12 + 30)::BIGINT + 1), lambda j:
    exp(-rate + j * ln(rate) - coalesce(list_sum(list_transform(range(1, j + 1), lambda i: ln(i::DOUBLE))), 0.0))) AS pmf
  FROM rates),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / pow(2::DOUBLE, 52) AS u, pmf
  FROM documents d JOIN laws l ON d.source IS NOT DISTINCT FROM l.source),
counted AS (
  SELECT * EXCLUDE (u, pmf), len(list_filter(range(1, len(pmf) + 1), lambda k: list_sum(pmf[1:k]) <= u)) AS copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted WHERE copies > 0
"""


def _quality_sql() -> str:
    lists = " ".join(f"WHEN lang = '{lang}' THEN {words!r}" for lang, words in quality.COMMON_WORDS.items())
    share = lambda c: f"list_transform({c}, lambda x: x / greatest(list_sum({c}), 1)::DOUBLE)"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0.0 END"
    terms = part.format("p[i]", "q[i]") + " + " + part.format("q[i]", "p[i]")
    stray = f"(len({{0}}) - 1 + {quality.SIGMAS}::DOUBLE * sqrt(2.0::DOUBLE * (len({{0}}) - 1))) / (n_words * (8 * ln(2::DOUBLE)))"
    classes = ["[^A-Z]", "[^0-9]", "[^.,;:!?''\"()-]", "[^#*$%&|<>]", "[^ß-ÿ]"]
    counts = ", ".join(f"length(regexp_replace(rest, '{c}', '', 'g'))" for c in classes)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    regexp_replace(coalesce(text, ''), '[a-z\\x20\\x09-\\x0D]', '', 'g') AS rest
  FROM documents),
windows AS (SELECT r, i, words[i : i + 7] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
base AS (
  SELECT d.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CASE {lists} ELSE {quality.ALL_WORDS!r} END AS listed
  FROM docs d LEFT JOIN covered c USING (r)),
counted AS (
  SELECT *, [word_chars - length(rest), {counts}] AS part, list_transform(listed, lambda c: len(list_filter(words, lambda x: x = c))) AS found FROM base),
histograms AS (
  SELECT * EXCLUDE (part, found), list_append(part, word_chars - list_sum(part)) AS chars, list_append(found, n_words - list_sum(found)) AS common FROM counted),
sums AS (SELECT lang, pos, sum(chars[pos]) AS c, sum(common[pos]) AS w FROM histograms, (SELECT unnest(range(1, {len(quality.ALL_WORDS) + 2})) AS pos) GROUP BY lang, pos),
refs AS (SELECT lang, list(c ORDER BY pos) FILTER (c IS NOT NULL) AS ref_chars, list(w ORDER BY pos) FILTER (w IS NOT NULL) AS ref_common FROM sums GROUP BY lang),
pairs AS (
  SELECT h.*, {share('chars')} AS cp, {share('ref_chars')} AS cq, {share('common')} AS wp, {share('ref_common')} AS wq
  FROM histograms h JOIN refs r ON h.lang IS NOT DISTINCT FROM r.lang),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words >= {quality.MIN_WORDS} THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len(cp) + 1), lambda i: {terms.replace('p[i]', 'cp[i]').replace('q[i]', 'cq[i]')})) / 2)) END AS char_distance,
    CASE WHEN n_words >= {quality.MIN_WORDS} THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len(wp) + 1), lambda i: {terms.replace('p[i]', 'wp[i]').replace('q[i]', 'wq[i]')})) / 2)) END AS word_distance
  FROM pairs)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  round(char_distance, 9) AS char_distance, round(word_distance, 9) AS word_distance,
  NOT base_failed AND NOT coalesce(char_distance > {quality.CHAR_MARGIN}::DOUBLE + sqrt({stray.format("chars")})
    OR word_distance > sqrt({quality.WORD_MARGIN}::DOUBLE * {quality.WORD_MARGIN}::DOUBLE + {stray.format("common")}), false) AS kept
FROM judged
"""


ORACLES["op4_quality_rules"] = _quality_sql()


ORACLES["op8_line_dedup"] = f"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
filled AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda k: regexp_matches(lines[k], '[^\\x20\\x09-\\x0D]')) AS places FROM docs),
counted AS (
  SELECT *, list_transform(places, lambda k: lines[k]) AS real,
    list_transform(places, lambda k: len(list_filter(string_split_regex(lines[k], '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS n FROM filled),
sums AS (SELECT *, list_transform(range(0, len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)) AS s FROM counted),
starts AS (SELECT r, real, n, s, unnest(range(1, len(real) + 1)) AS i FROM sums),
runs AS (
  SELECT r, real, i AS a, list_min(list_filter(range(i, len(real) + 1), lambda b: s[b + 1] - s[i] >= {linededup.MIN_WORDS})) AS b FROM starts
  UNION
  SELECT r, real, list_max(list_filter(range(1, i + 1), lambda a: s[i + 1] - s[a] >= {linededup.MIN_WORDS})) AS a, i AS b FROM starts),
keyed AS (SELECT r, a, b, real[a:b] AS run FROM runs WHERE a IS NOT NULL AND b IS NOT NULL),
copies AS (SELECT r, a, b FROM keyed QUALIFY row_number() OVER (PARTITION BY run ORDER BY r, a) > 1),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(a, b + 1)) AS i FROM copies) GROUP BY r)
SELECT doc_id, len(coalesce(places, []))::BIGINT AS n_lines, len(coalesce(gone, []))::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text WHEN len(gone) = len(places) THEN ''
    ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda k: NOT list_contains(list_transform(gone, lambda i: places[i]), k)), lambda k: lines[k]), chr(10)) END AS text
FROM sums LEFT JOIN gone USING (r)
"""


ORACLES["op13_exact_dedup"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(t) AS text_sha256,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
FROM docs WINDOW same AS (PARTITION BY t)
"""


ORACLES["op12_ranked_lexical_search"] = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS (
  SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
sums AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS total FROM words),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY r, doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, sums GROUP BY term, n_docs),
impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // total))) AS impact
  FROM held JOIN lengths USING (r), sums),
scores AS (
  SELECT q, item_id, r, doc_id, sum(w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, item_id, r, doc_id)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""


ORACLES["op11_vector_code_compression"] = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT row, vec_id, label, p, v[p * w + 1 : p * w + w] AS v
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, len(v) // 16 AS w FROM kept), (SELECT unnest(range(0, 16)) AS p)),
book0 AS (SELECT p, row - 1 AS e, v AS c FROM parts WHERE row <= 64),
"""
for _round in (1, 2, 3):
    ORACLES["op11_vector_code_compression"] += f"""
near{_round} AS (
  SELECT row, p, min({{d: list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT, e: e}}) AS best
  FROM parts JOIN book{_round - 1} USING (p) GROUP BY row, p),"""
    if _round < 3:
        ORACLES["op11_vector_code_compression"] += f"""
means{_round} AS (
  SELECT p, e, list(mean ORDER BY j) AS c FROM (
    SELECT p, best.e AS e, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS mean
    FROM near{_round} JOIN parts USING (row, p), (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS j) GROUP BY p, best.e, j) GROUP BY p, e),
book{_round} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{_round - 1} b LEFT JOIN means{_round} m USING (p, e)),"""
ORACLES["op11_vector_code_compression"] += """
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near3 GROUP BY row),
hashed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN (SELECT row, vec_id, label FROM parts WHERE p = 0) USING (row), hashed
"""
