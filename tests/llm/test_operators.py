"""The operators against brute force on small tables, with nulls, empty and long texts, ties and clashing names."""

import base64
import collections
import itertools
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectide.llm import baseline, bytebpe, flatscan, graph, linededup, media, mixing, pii, quality, seekable, sharding, simhash
from vectide.llm.tokenizing import PieceEncoder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (0, "The cat sat on the mat.\nIt was the best of the times, and the worst.", "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "de", "b", 3),
    (4, "word " * 30_000, "en", "a", 1),
    (5, "ünï¢ødé ☃ 漢字 \U0001f600 don't we'll 123 ''  　x\r\n\x85", "fr", "b", 2),
    (5, "ünï¢ødé ☃ 漢字 \U0001f600 don't we'll 123 ''  　x\r\n\x85", "fr", "b", 2),
    (None, "Repeated row without an id", None, "c", 9),
    (None, "Repeated row without an id", None, "c", 9),
]
WORDS = [a + b for a in "bcdfghklmnpr" for b in ("an", "elo", "ir", "ou", "ust", "eth")]


def texts(n, seed=1, words=(1, 200)):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(rng.randint(*words))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).coalesce(2)


def stable(spark, tmp_path_factory, rows, schema=SCHEMA):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


# 1


def test_shards_have_exact_sizes_and_gapless_slots(spark, tmp_path_factory):
    df = stable(spark, tmp_path_factory, [(i % 7 if i % 3 else None, t, "en", "s", 1) for i, t in enumerate(texts(501))])
    got = sharding.shard_rows(clashing(df, "shard", "SLOT", "_shard_key"), 8, seed=3, stable=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [62] * 3 + [63] * 5
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.text for r in got) == sorted(r.text for r in df.collect())
    again = sharding.shard_rows(df, 8, seed=3, stable=True).collect()
    assert sorted((r.text, r.shard, r.slot) for r in again) == sorted((r.text, r.shard, r.slot) for r in got)
    other = sharding.shard_rows(df, 8, seed=4, stable=True).collect()
    assert sorted((r.text, r.shard, r.slot) for r in other) != sorted((r.text, r.shard, r.slot) for r in got)


def test_shards_of_odd_and_empty_tables(odd):
    assert sharding.shard_rows(odd, 4).count() == len(ODD)
    assert sharding.shard_rows(odd.where("false"), 4).collect() == []


def test_hypergeometric_draws_follow_the_distribution(spark):
    n = 20_000
    k = sharding.hypergeometric(F.lit(30), F.lit(100), F.lit(20), (F.col("id") + 0.5) / n)
    for r in spark.range(n).select(k.alias("k")).groupBy("k").count().collect():
        assert abs(r["count"] - n * math.comb(30, r.k) * math.comb(70, 20 - r.k) / math.comb(100, 20)) <= 2
    edge = spark.range(1).select(*[sharding.hypergeometric(F.lit(g), F.lit(t), F.lit(d), F.lit(0.5)) for g, t, d in ((0, 5, 3), (5, 5, 3), (3, 5, 0), (3, 5, 5), (0, 0, 0))]).first()
    assert tuple(edge) == (0, 3, 0, 3, 0)


def test_communication_matrix_has_both_margins(spark):
    sizes = [17, 1, 250, 3, 99, 42, 5]
    rows = sharding.communication_matrix(spark.createDataFrame(list(enumerate(sizes)), "_shard_part int, n long"), len(sizes), 5, 9).collect()
    assert {r._shard_part: sum(r._shard_counts) for r in rows} == dict(enumerate(sizes))
    total = sum(sizes)
    assert [sum(c) for c in zip(*[r._shard_counts for r in rows])] == [total // 5 + (s < total % 5) for s in range(5)]


# 2


@pytest.fixture(scope="module")
def vocab(spark):
    return bytebpe.Vocabulary(spark, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("cached", [True, False])
def test_bpe_is_the_librarys(spark, odd, vocab, library, monkeypatch, cached):
    if not cached:
        monkeypatch.setattr(bytebpe, "WORDS", 3)
        monkeypatch.setattr(bytebpe, "SAMPLE", 1)
    more = spark.createDataFrame([(10 + i, t, "en", "s", 1) for i, t in enumerate([*texts(20), "aaaaabbbbb" * 40, "<|endoftext|>", "x" * 300, "�\u0000 é" * 5])], SCHEMA)
    df = clashing(odd.unionByName(more), "ids", "decoded", "_bpe")
    for r in bytebpe.decode(bytebpe.encode(df, vocab), vocab).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_very_long_pieces(spark, vocab, library):
    rng = random.Random(3)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    made = [letters(257), letters(256), letters(32_000), letters(16_000) + " and " + letters(300) + "\n" * 400, "a" * 100_000, "漢字" * 5000, "\u3000" * 600 + "x", "!?" * 700, " " * 2000 + letters(200, "éüñ") * 3]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], SCHEMA)
    for r in bytebpe.decode(bytebpe.encode(clashing(df, "ids", "decoded"), vocab), vocab).collect():
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abetrshn é漢", min_size=1, max_size=80))
def test_long_folds_are_the_librarys(text):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = test_long_folds_are_the_librarys.__dict__.setdefault("r", bytebpe.read_ranks(path))
    library = test_long_folds_are_the_librarys.__dict__.setdefault("l", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    for piece in re.findall(r"[^ ]+", text):
        assert bytebpe.fold_long(piece.encode(), ranks) == library._encode_single_piece(piece.encode())


def test_bpe_of_a_large_vocabulary(spark, odd, tmp_path, library):
    ranks = bytebpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (3 * r) for t, r in ranks.items()))
    large = bytebpe.Vocabulary(spark, str(path), public_tokenizers.PATTERN)
    df = odd.unionByName(spark.createDataFrame([(10 + i, t, "en", "s", 1) for i, t in enumerate([*texts(20), "aaaaabbbbb" * 12])], SCHEMA))
    for r in bytebpe.decode(bytebpe.encode(df, large), large).collect():
        assert r.ids == [3 * i for i in library.encode_ordinary(r.text or "")] and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_no_rows_and_unknown_ids(spark, odd, vocab):
    assert bytebpe.encode(odd.where("false"), vocab).collect() == []
    df = spark.createDataFrame([([1, 99_999_999],), ([-1],), ([],), (None,)], "ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in bytebpe.decode(df, vocab).collect()] == [None, None, b"", None]


# 3 and 7


def test_flat_files_count_tokens(spark, odd, library):
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(texts(60))], SCHEMA)).coalesce(3)
    written = flatscan.write_flat_files(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), 50256)
    files = written.where("file_bytes is not null").select("file", "file_bytes")
    for block in (1 << 20, 37):
        got = written.join(flatscan.count_documents(files, 50256, block), ["file", "document"], "left").collect()
        want = sorted(((r.doc_id if r.doc_id is not None else -1), len(library.encode_ordinary(r.text or ""))) for r in docs.collect())
        assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in got) == want
        assert all(r.ended for r in got)
    assert flatscan.write_flat_files(odd.where("false"), vocabulary("byte_bpe_multi_50k.tiktoken"), 50256).count() == 0


def test_unended_and_separator_only_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 4, 5], "<u2").tofile(tmp_path / "a")
    np.array([1] * 10, "<u2").tofile(tmp_path / "b")
    files = spark.createDataFrame([(str(tmp_path / "a"), 14), (str(tmp_path / "b"), 20), ("none", 0)], "file string, file_bytes long")
    want = [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 3, False), ("b", 0, 10, False)]
    for block in (2, 3, 100):
        assert sorted((r.file[-1], r.document, r.n_tokens, r.ended) for r in flatscan.count_documents(files, 9, block).collect()) == want
    # wide ids: 65,545 is no 9
    np.array([1, 65_545, 9, 9, 3, 4, 5], "<u4").tofile(tmp_path / "a")
    np.array([70_000] * 10, "<u4").tofile(tmp_path / "b")
    files = spark.createDataFrame([(str(tmp_path / "a"), 28), (str(tmp_path / "b"), 40)], "file string, file_bytes long")
    assert sorted((r.file[-1], r.document, r.n_tokens, r.ended) for r in flatscan.count_documents(files, 9, 3, id_bytes=4).collect()) == want


def test_many_blocks_and_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flatscan, "SPAN", 3)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, 500).astype("<u2")
    x[100:200] = 1
    x.tofile(tmp_path / "c")
    ends = [-1, *np.flatnonzero(x == 9).tolist()]
    want = [(i, b - a - 1, True) for i, (a, b) in enumerate(zip(ends, ends[1:]))] + [(len(ends) - 1, len(x) - 1 - ends[-1], False)] * (ends[-1] < len(x) - 1)
    files = spark.createDataFrame([(str(tmp_path / "c"), 1000)], "file string, file_bytes long")
    for block in (1, 7, 64):
        assert sorted((r.document, r.n_tokens, r.ended) for r in flatscan.count_documents(files, 9, block).collect()) == want


def test_wide_vocabularies_take_four_bytes(spark, tmp_path, odd):
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (b * 1000) for b in range(256)))
    assert flatscan.id_bytes(str(path), 255_001) == 4 and flatscan.id_bytes(vocabulary("byte_bpe_multi_50k.tiktoken"), 50256) == 2
    written = flatscan.write_flat_files(odd, str(path), 255_001)
    counts = flatscan.count_documents(written.where("file_bytes is not null").select("file", "file_bytes"), 255_001, id_bytes=4)
    got = written.join(counts, ["file", "document"], "left").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode())) for r in odd.collect())


def test_hadoop_schemes_are_known():
    from vectide.llm import common

    with pytest.raises(Exception) as e:
        common.open_fs("s3a://no-such-bucket-name/none?endpoint_override=localhost:1&region=x")[0].get_file_info("no-such-bucket-name/none")
    assert "Unrecognized" not in str(e.value)


def test_seekable_files(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(1000 - i, t, "en", "s", 1) for i, t in enumerate(texts(50))], SCHEMA))
    files = seekable.write_token_files(docs, vocabulary("byte_bpe_50k.json"), 2)
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in seekable.token_documents(files).orderBy("start").collect()]
    assert got == want
    some = seekable.read_token_files(files.withColumn("frames", F.array(F.lit(0))))
    assert some.count() == files.count() and {r.frame for r in some.collect()} == {0}
    asked = spark.createDataFrame([(5,), (960,), (None,), (77,), (960,)], "doc_id long")
    found = sorted(((r.doc_id, bytes(r.ids)) for r in seekable.read_documents(files, asked).collect()), key=str)
    assert found == sorted(((d, ids) for d, _, _, ids in want if d in (5, 960, None)), key=str) and len(found) == 5
    assert seekable.read_documents(files, asked.where("doc_id = 77")).count() == 0 == seekable.read_documents(files, asked.where("false")).count()
    none = seekable.write_token_files(odd.where("false"), vocabulary("byte_bpe_50k.json"), 2)
    assert seekable.token_documents(none).count() == 0 == seekable.read_documents(none, asked).count()


def test_repeated_and_null_ids_are_spread_over_files(spark):
    rows = [(None if i % 2 else 7, f"text {i}", "en", "s", 1) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join so small ranges
    try:
        files = seekable.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(4), vocabulary("byte_bpe_50k.json"), 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(files) >= 4 and max(f.n_docs for f in files) < 200


def test_damaged_frames_are_found(tmp_path):
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "f")
    w = seekable.FrameWriter(store.open_output_stream(path, compression=None))
    for i in range(5):
        w.add(i, struct.pack("<3I", i, i, i))
    w.close()
    assert [k for _, k, _, _ in seekable.read_frames(store.open_input_file(path))] == list(range(5))
    data = bytearray(open(path, "rb").read())
    data[len(data) - 9 - 12 * 6 + 8] ^= 1  # the first frame's checksum in the seek table
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(seekable.read_frames(store.open_input_file(path)))
    open(path, "wb").write(b"nothing of the kind")
    with pytest.raises(ValueError):
        list(seekable.read_frames(store.open_input_file(path)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_piece_encoder_is_the_library(text):
    encode = test_piece_encoder_is_the_library.__dict__.setdefault("e", PieceEncoder(vocabulary("byte_bpe_50k.json")))
    for t in (text, text + " don't stop\n\n  now 12\xa034"):
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "漢 <|endoftext|>"])
def test_piece_encoder_keeps_added_tokens(text):
    path = vocabulary("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert 50256 in want and np.frombuffer(PieceEncoder(path)(text), "<u4").tolist() == want


# 4


def test_quality_counts(spark, odd):
    rows = [(100 + i, t + (t if i % 3 == 0 else ""), "en", "s", 1) for i, t in enumerate(texts(60, words=(5, 60)))] + [(999, "# $ the\nthe\nthe\n\n \nthe x\n" * 3, "xx", "s", 1)]
    df = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = quality.judge(clashing(df, "kept", "N_WORDS", "_q_words")).collect()
    assert len(got) == df.count()
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * repeated > 30 * len(w))
        assert not (r.base_failed and r.kept) and (r.char_distance is None) == (len(w) < quality.MIN_WORDS)
    assert quality.judge(odd.where("false")).collect() == []


def test_divergent_texts_are_rejected(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "of", "and", "to", "house", "river", "walked", "bright", "morning", "slowly"]) for _ in range(150)) for _ in range(40)]
    junk = [" ".join(rng.choice(["###", "$$9", "ZQX!!", "|", "%%%"]) for _ in range(150)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(clean + junk)], SCHEMA)
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(40))


def test_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([1, 0], [0, 5]), ([3, 1], [6, 2]), ([0, 0], [1, 1])], "a array<int>, b array<int>")
    d = [r[0] for r in df.select(quality.distance(F.col("a"), F.col("b"))).collect()]
    assert d[0] == 1.0 and d[1] == 0.0 and 0 < d[2] < 1


# 5

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0, "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890@.-+() _%é\n", max_size=80))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_real_kinds():
    t = "a.b@c.de_x@f.gh 1.2.3.4.5.6.7.8, 4111 1111-1111 1111, +1 (743) 555-3824, 999.1.1.1, 4111111111111112, " + "9" * 5000
    assert pii.base_spans(t) == plain_spans(t) and {k for _, k, _ in pii.base_spans(t)} == {0, 1, 2, 3}


def test_repeats_get_the_label_and_clean_texts_none(spark, odd):
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = []
    for i in range(200):
        n = number()
        rows.append((i, f"Call +1 (743) {n} now, or later {' '.join(rng.choice(WORDS) for _ in range(20))} again {n} please. Order 12 of 2024.", "en", "s", 1))
    clean = [(1000 + i, t + " in 1999, 555-1234 of 12", "en", "s", 1) for i, t in enumerate(texts(20))]
    got = pii.tag(clashing(spark.createDataFrame(rows + clean, SCHEMA).unionByName(odd), "spans")).collect()
    found = 0
    for r in got:
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base]
        assert base == plain_spans(r.text or "")
        assert list(r.spans) == sorted(r.spans, key=lambda s: (s.start, pii.KINDS.index(s.kind)))
        extra = [s for s in r.spans if not s.base]
        if r.doc_id is None or r.doc_id >= 200 or r.doc_id < 10 and len(r.text or "") < 80:
            assert not extra
        found += any(re.fullmatch(r"\d{3}-\d{4}", r.text[s.start : s.end]) and s.kind == "phone" for s in extra)
        assert not any(r.text[s.start : s.end] in ("12", "2024") for s in extra)
    assert found >= 180
    assert pii.tag(odd.where("false")).collect() == []


def exact_marginals(g, w):
    """Label probabilities by summing over all labelings."""
    k, n = len(pii.LABELS), len(g.at)
    x, c = pii.unpacked(g.x) @ np.array(w.unary), np.array(w.chain)
    for row, mask in zip(x, g.x):  # a mixed token is as likely none as a secret, and a key name is one that is observed
        row[0] = max(row[0], row[5]) if mask >> pii.FEATURES.index("mixed") & 1 else row[0]
        row[6] = -30.0
    p = np.zeros((n, k))
    for labels in itertools.product(*([seen] if seen else range(k) for seen in g.y)):
        weight = math.exp(
            sum(x[i, v] for i, v in enumerate(labels) if not g.y[i])
            + sum(c[labels[i], labels[j]] for i, j in g.chain)
            + sum(w.skip for i, j in g.skip if labels[i] == labels[j])
        )
        for i, v in enumerate(labels):
            p[i, v] += weight
    return p / p.sum(axis=1, keepdims=True)


def test_messages_give_exact_marginals_on_a_tree():
    rng, k, f = np.random.default_rng(3), len(pii.LABELS), len(pii.FEATURES)
    w = pii.Weights(rng.normal(size=(f, k)).tolist(), rng.normal(size=(k, k)).tolist(), 0.7)
    for seen in (0, 2):
        g = pii.Graph([(0, 1), (2, 3), (4, 5), (6, 7)], [1, 3, 5, 17], [0, 0, 0, seen], [(0, 1), (2, 3)], [(1, 2)], [0, 1, 2, 3])
        assert np.allclose(pii.marginals(g, w), exact_marginals(g, w), atol=1e-3)


#: Texts with what the patterns leave out, and the spans that the field is to add.
HIDDEN = [
    ("Numbers 2353820953013749 4550997810720808 stand side by side.", [("card", "4550997810720808")]),
    ("Phone +1 (826) 555-4081 190.137.223.204 ran on.", [("phone", "+1 (826) 555-4081")]),
    ('The token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is here.', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ("api_key: 04dbebab91ab85687d33eeaaf9ac699e1188f962 and 04dbebab91ab85687d33eeaaf9ac699e1188f962 again", [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")] * 2),
    ("Write to ann.lee at mail dot example dot org today", [("email", "ann.lee at mail dot example dot org")]),
    ("Ask bob(at)host[dot]net now", [("email", "bob(at)host[dot]net")]),
    ("From 10[.]20[.]30[.]40 it came", [("ip", "10[.]20[.]30[.]40")]),
    ("Call +1 (743) 555-9182 or else 555-9182 later", [("phone", "555-9182")]),
    ("Card 4550997810720808 then ************0808 ends", [("card", "0808")]),
    ("token=04dbebab91ab85687d33eeaaf9ac699e1188f962; then 04DBEBAB91AB85687D33EEAAF9AC699E1188F962", [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("secret", "04DBEBAB91AB85687D33EEAAF9AC699E1188F962")]),
    ("The checksum 04dbebab91ab85687d33eeaaf9ac699e1188f962 is not one, nor is the token of 2024", []),
    ("Only 16 digits: 2353820953013749 and version 2.0 of 1999, 555-1234, rev 3.11", []),
    ("He met me at the dot on the map in 2024", []),
    ("", []),
]


def training_texts():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for i in range(300):
        card = digits(16)
        while pii.luhn(card) != (i % 2 == 0):
            card = digits(16)
        word = lambda: rng.choice(WORDS)
        hidden = digits(12) + "abcdef" + digits(8) + "bcd"
        out.append(
            f"{word()} {card} {word()} v.{i % 50}@mail.example.com {word()} +1 ({digits(3)}) 555-{digits(4)} {word()} 10.{i % 200}.3.4 {word()} "
            f'token = "{hidden}" {word()} in {1900 + i % 120}, {digits(3)}-{digits(4)} or {i % 9}.{i % 7} end'
        )
    return out


@pytest.fixture(scope="module")
def field_weights(spark):
    return pii.fit(spark.createDataFrame([(t,) for t in training_texts()], "text string"))


@pytest.mark.parametrize(("text", "want"), HIDDEN)
def test_the_field_finds_what_patterns_leave_out(field_weights, text, want):
    spans = pii.find_spans(text, field_weights)
    assert [s[:3] for s in spans if s[3]] == plain_spans(text)
    assert [(pii.ALL_KINDS[k], text[a:b]) for a, k, b, base in spans if not base] == want


def test_messages_decide(field_weights):
    """Without chain and skip messages no secret, repeat or part is found; tokens that tell by themselves are."""
    lost = {}
    for text, want in HIDDEN:
        base = plain_spans(text)
        g = pii.graph_of(text, base)
        g.chain, g.skip = [], []
        found = [] if all(g.y) else pii.decode(text, g, pii.marginals(g, field_weights))
        mine = [(pii.ALL_KINDS[k], text[a:b]) for a, k, b in found]
        assert all(f in want for f in mine)
        for kind, what in want:
            if (kind, what) not in mine:
                lost.setdefault(kind, []).append(what)
    assert len(lost["secret"]) == 5 and "555-9182" in lost["phone"] and lost["card"] == ["0808"]


@pytest.mark.parametrize("text", [t for t, _ in HIDDEN if t])
def test_spans_are_those_of_the_exact_field(field_weights, text):
    base = plain_spans(text)
    g = pii.graph_of(text, base)
    assert len(g.at) <= 7
    assert pii.added_spans(text, base, field_weights) == ([] if all(g.y) else pii.decode(text, g, exact_marginals(g, field_weights)))


def test_fit_sums_counts_over_all_texts(spark, odd, field_weights):
    import collections

    counts = collections.Counter()
    for t in training_texts():
        counts.update(pii.observations(pii.graph_of(t, plain_spans(t))))
    assert pii.learn(counts) == field_weights
    assert pii.fit(odd.where("false")) == pii.default_weights()


# 6


def slow_fingerprint(text, width=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(n, edges):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in edges:
        a, b = top(i), top(j)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_copies(n, seed):
    rng, out = random.Random(seed), []
    for t in texts(n, seed, (60, 300)):
        out.append(t)
        w = t.split(" ")
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("tile", [7, 4096])
def test_simhash_components(spark, odd, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LARGE_TILE", tile)
    df = odd.unionByName(spark.createDataFrame([(50 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(60, 5))], SCHEMA))
    prints = simhash.fingerprints(clashing(df, "words", "component_id"), "text", 4)
    rows = simhash.near_duplicates(prints, 4).collect()
    ids = [(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()]
    fp = [f for _, f in ids]
    label = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {c: min(d for (d, _), x in zip(ids, label) if x == c and d is not None) if any(d is not None for (d, _), x in zip(ids, label) if x == c) else None for c in label}
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.words[0] % 2**64, r.component_id) for r in rows), key=key) == sorted(((d, f, least[c]) for (d, f), c in zip(ids, label)), key=key)
    assert simhash.near_duplicates(simhash.fingerprints(odd.where("false"), "text", 4), 4).collect() == []


@pytest.mark.parametrize(("words", "radius"), [(1, 4), (1, 12), (4, 40)])
def test_forest_connects_all_links(words, radius):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**63, (20, words), dtype=np.uint64)
    x = np.repeat(base, 12, axis=0)
    for row in x:
        for _ in range(rng.integers(0, radius)):
            row[rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    near = [(i, j) for i in range(len(x)) for j in range(i) if np.bitwise_count(x[i] ^ x[j]).sum() <= radius]
    forest = list(simhash.link_forest(x, x, True, radius))
    assert components(len(x), forest) == components(len(x), near) and len(forest) < len(x)
    a, b = x[:100], x[100:]
    both = [(i, j + 100) for i, j in simhash.link_forest(a, b, False, radius)]
    assert components(len(x), both) == components(len(x), [(j, i) for i, j in near if j < 100 <= i])


@pytest.mark.parametrize("split", [(21, 25, 0, 0), (46, 0, 0, 0), (0, 0, 0, 46), (12, 11, 12, 11)])
def test_forest_has_links_whose_bits_lie_in_one_word(split):
    a = np.random.default_rng(5).integers(0, 2**63, (3, 4), dtype=np.uint64)
    b = a.copy()
    b[0] ^= np.array([(1 << n) - 1 for n in split], np.uint64)
    b[1] ^= np.array([(1 << n) - 1 for n in (*split[:3], split[3] + 1)], np.uint64)
    assert list(simhash.link_forest(a[:2], b[:2], False, 46)) == [(0, 0)]
    assert list(simhash.link_forest(np.stack([a[0], b[0], a[2]]), np.stack([a[0], b[0], a[2]]), True, 46)) in ([(0, 1)], [(1, 0)])


@pytest.mark.parametrize("block", [300, 1 << 19])
def test_similar_duplicates_are_exact(spark, odd, monkeypatch, block):
    """Groups of near copies, and chains of texts of which only some neighbours are near enough."""
    monkeypatch.setattr(simhash, "BLOCK_HASHES", block)
    rng, made = random.Random(9), near_copies(25, 8)
    for t in texts(6, 77, (80, 160)):
        w = t.split(" ")
        for _ in range(12):  # a chain: each text differs a little more from the first
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            made.append(" ".join(w))
    rows = [(50 + i, t, "en", "s", 1) for i, t in enumerate(made)]
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(rows, SCHEMA))
    docs = clashing(df, "words", "same", "component_id", "part", "id", "group")
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(docs, "text", "doc_id", 5, 0.8, 76, 4).collect()}
    all_rows = sorted((r.doc_id, r.text) for r in df.collect())
    sets = [set(simhash._hashes(t, 5)) for _, t in all_rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = components(len(sets), links)
    assert got == {d: all_rows[c][0] for (d, _), c in zip(all_rows, label)}
    assert 20 < len(set(label)) < len(label) and any(0.6 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for i in range(60, len(sets)) for j in range(i))
    assert simhash.similar_duplicates(docs.where("false"), "text", "doc_id", 5, 0.8, 76, 4).collect() == []


def test_similar_texts_of_a_million_words(spark):
    words = [f"{WORDS[i % len(WORDS)]}{i % 9973}" for i in range(1_000_000)]
    near, far = list(words), list(words)
    for i in range(0, len(words), 100):
        near[i] = "other"
    for i in range(0, len(words), 30):
        far[i] = "third"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "a short text of some words")]
    sets = [set(simhash._hashes(t, 5)) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = components(4, [(i, j) for i in range(4) for j in range(i) if alike(i, j)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(docs, "text", "doc_id", 5, 0.8, 76, 4).collect()}
    assert got == {d: rows[c][0] for (d, _), c in zip(rows, label)} and alike(0, 1) and not alike(0, 2)


def test_sizes_rule_pairs_out(spark):
    items = spark.createDataFrame([(i, [7, i, -i, 3], 10 + i) for i in range(300)], "id long, words array<long>, n long")
    _, sizes, met = simhash.classes(items, 76, 4, 0.8)
    _, plain, all_met = simhash.classes(items, 76, 4)
    work = lambda s, m: sum(s[c] * s[d] for c, d in m)
    assert sum(sizes.values()) == 300 and work(sizes, met) < work(plain, all_met) / 2
    place = {r.id: (r.h, r.w) for r in simhash.classes(items, 76, 4, 0.8)[0].collect()}
    pairs = {frozenset(p) for p in met} | {frozenset([c]) for c in sizes}
    for a in range(300):
        for b in range(a, 300):
            if min(10 + a, 10 + b) >= 0.8 * max(10 + a, 10 + b) and abs(place[a][0] - place[b][0]) <= 1:
                assert frozenset([place[a], place[b]]) in pairs


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = components(1200, [e for e in edges if e[0] != e[1]])
    assert got == {i: label[i] for e in edges if e[0] != e[1] for i in e}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# 8


def slow_dedup(rows, least):
    """Later copies of all runs of enough words, by trying every run."""
    seqs = [[(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    for d, s in enumerate(seqs):
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += len(WORD.findall(s[b][1]))
                if n >= least and first.setdefault(tuple(x for _, x in s[a : b + 1]), (d, a)) != (d, a):
                    gone[d].update(range(a, b + 1))
    out = []
    for (_, t), s, g in zip(rows, seqs, gone):
        drop = {s[i][0] for i in g}
        out.append(None if t is None else "" if g and len(g) == len(s) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
    return out


def test_line_dedup_is_exact(spark, tmp_path_factory):
    rng = random.Random(8)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(30)] + ["", " "]
    passage = [rng.choice(lines) for _ in range(9)]
    rows = []
    for i in range(120):
        body = [rng.choice(lines) if rng.random() < 0.7 else f"only {i} {k}" for k in range(rng.randint(0, 25))]
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        rows.append((i, "\n".join(body)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None), (301, ""), (302, "same line\n" * 40)]
    df = stable(spark, tmp_path_factory, rows, "doc_id long, text string")
    for least in (4, 12):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(clashing(df, "n_lines", "_ld_row"), min_words=least, stable=True).collect()}
        assert got == dict(zip([d for d, _ in rows], slow_dedup(rows, least)))


def test_line_dedup_of_odd_tables(spark, odd):
    got = linededup.dedup_lines(odd, min_words=3)
    texts_left = [r.text for r in got.collect()]
    assert len(texts_left) == len(ODD) and texts_left.count("") == 3 and texts_left.count(None) == 1
    assert linededup.dedup_lines(odd.where("false")).collect() == []


# 9


def test_poisson_counts(spark):
    n = 20_000
    for rate in (0.2, 3.0, 150.0):
        law = mixing.poisson_cdf(F.lit(rate))
        k = spark.range(n).select((law["first"] + F.size(F.filter(law["cdf"], lambda c: c <= (F.col("id") + 0.5) / n))).alias("k"))
        mean, var = k.agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(mean - rate) < 0.02 * rate + 0.01 and abs(var - rate) < 0.05 * rate


def test_very_many_sources_are_joined_by_their_size(spark, odd, monkeypatch):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 40}" if i % 40 else None, 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(odd.where("doc_id is not null")).repartition(4)
    key = lambda out: sorted(((r.doc_id, r.text, r.source, r.copies, r.copy) for r in out.collect()), key=str)
    want = [key(mixing.mix_sources(df, seed=3)), key(mixing.mix_sources(df, {"hot": 1.0, None: 2.0, "s3": 0.0}, seed=3))]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert [key(mixing.mix_sources(df, seed=3)), key(mixing.mix_sources(df, {"hot": 1.0, None: 2.0, "s3": 0.0}, seed=3))] == want and all(want)


def test_mixture(spark, odd):
    rows = [(i, t, "en", "big" if i % 4 else None, 1) for i, t in enumerate(texts(2000, words=(1, 5)))]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "copy", "COPIES", "_mix_key")
    out = mixing.mix_sources(df, {None: 1.0, "big": 1.0}, total=2000, seed=5).collect()
    share = collections.Counter(r.source for r in out)
    assert abs(share[None] - 1000) < 120 and abs(share["big"] - 1000) < 120
    copies = collections.Counter(r.doc_id for r in out)
    assert all(copies[r.doc_id] == r.copies for r in out) and {r.copy for r in out if r.copies == 3} == {1, 2, 3}
    again = mixing.mix_sources(df.repartition(5), {None: 1.0, "big": 1.0}, total=2000, seed=5).collect()
    assert collections.Counter(r.doc_id for r in again) == copies
    assert {r.source for r in mixing.mix_sources(df, {"big": 1.0}).collect()} == {"big"}
    assert mixing.mix_sources(odd.where("false")).collect() == [] and mixing.mix_sources(odd, {"nowhere": 1.0}).collect() == []
    assert mixing.mix_sources(odd, temperature=1.0).count() >= 0


# 10


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_media_roundtrip(data):
    payload = media.pad_payload(data)
    assert payload.startswith(data) and len(payload) % 192 == 0 and payload and set(payload[len(data) :]) <= {32}
    frames, back, clips, error = media.analyse(media.payload_to_avi(payload))
    assert (back, error) == (payload, None) and clips[0]["start_frame"] == 0 and clips[-1]["end_frame"] == frames


def test_media_columns(odd):
    made = media.texts_to_avi(clashing(odd, "media", "n_bytes", "frames"))
    got = media.avi_clips(made).collect()
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == media.pad_payload(raw) and r.n_bytes == len(raw) and r.error is None
    assert media.clip_rows(media.avi_clips(made), "doc_id").count() >= len(ODD)
    bad = media.avi_clips(odd.select("doc_id", F.when(F.col("doc_id") > 1, F.lit(b"RIFF....AVI ")).alias("media"))).collect()
    assert all(r.frames is None and r.error for r in bad)
    assert media.avi_clips(media.texts_to_avi(odd.where("false"))).collect() == []


def test_shots_and_files_without_index():
    rng = np.random.default_rng(0)
    scenes = [rng.integers(lo, lo + 40, (10, 24, 32)) for lo in (0, 120, 200)]
    x = np.concatenate(scenes).astype(np.uint8)
    avi = media.write_avi(media.encode_frames(x), 32, 24)
    assert media.shot_cuts(x) == [10, 20]
    cut = avi.replace(b"idx1", b"JUNK")
    for data in (avi, cut):
        info = media.read_avi(data)
        assert len(info["frames"]) == 30 and (media.decode_frames(data, info["frames"]) == x).all() and info["fps"] == 25
    assert media.analyse(avi[:-2000])[3] or media.analyse(avi[:-2000])[0]


def test_other_huffman_tables_are_decoded():
    x = np.arange(64, dtype=np.uint8).reshape(1, 8, 8)
    head = b"\xff\xd8" + media._segment(0xC3, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0])) + media._segment(0xC4, bytes([0, 0, 2, 2] + [0] * 13 + [1, 4, 0, 8])) + media._segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    codes = {1: "00", 4: "01", 0: "100", 8: "101"}
    d = x[0].astype(int).copy()
    d[:, 1:] = x[0][:, 1:].astype(int) - x[0][:, :-1]
    d[1:, 0] = x[0][1:, 0].astype(int) - x[0][:-1, 0]
    d[0, 0] = int(x[0, 0, 0]) - 128
    bits = ""
    for v in d.ravel().tolist():
        s = abs(v).bit_length()
        bits += codes[s] + (format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else "")
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = head + body + b"\xff\xd9"
    assert (media.decode_frames(frame, [(0, len(frame))]) == x).all()


def baseline_frame(planes, sampling=((1, 1),), tables=True, interval=0):
    """A baseline JPEG file of planes (height, width multiples of whole units), all quantized by 1 and coded by the standard's tables."""
    k = np.arange(8)
    cosines = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2 * np.where(k[:, None] == 0, np.sqrt(0.5), 1.0)
    kinds = [(baseline.DC_LUMINANCE, baseline.AC_LUMINANCE), (baseline.DC_CHROMINANCE, baseline.AC_CHROMINANCE)]

    def codes(table):
        out, code, at = {}, 0, 0
        for length, n in enumerate(table[0], 1):
            for _ in range(n):
                out[table[1][at]] = format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def block(x, before, kind):
        dc, ac = map(codes, kinds[kind])
        c = np.rint(cosines @ (x.astype(float) - 128) @ cosines.T).astype(int).ravel()
        size, bits = number(int(c[0]) - before)
        out, run = dc[size] + bits, 0
        for place in baseline.ZIGZAG[1:]:
            v = int(c[place])
            if not v:
                run += 1
                continue
            out += ac[0xF0] * (run // 16)
            size, bits = number(v)
            out, run = out + ac[run % 16 << 4 | size] + bits, 0
        return out + (ac[0] if run else ""), int(c[0])

    (a, d), (height, width) = sampling[0], planes[0].shape
    wide, high = -(-width // (8 * a)), -(-height // (8 * d))
    sections, bits, before = [], "", [0] * len(planes)
    for unit in range(wide * high):
        if interval and unit and unit % interval == 0:
            sections.append(bits)
            bits, before = "", [0] * len(planes)
        for p, (plane, (n, m)) in enumerate(zip(planes, sampling)):
            for i in range(n * m):
                y, x = 8 * (unit // wide * m + i // n), 8 * (unit % wide * n + i % n)
                more, before[p] = block(plane[y : y + 8, x : x + 8], before[p], min(p, 1))
                bits += more
    sections.append(bits)
    coded = b""
    for i, bits in enumerate(sections):
        bits += "1" * (-len(bits) % 8)
        coded += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = media._segment
    n = len(planes)
    out = b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64]))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling)))
    if tables:
        for i, (dc, ac) in enumerate(kinds):
            out += segment(0xC4, bytes([i, *dc[0], *dc[1]])) + segment(0xC4, bytes([0x10 | i, *ac[0], *ac[1]]))
    if interval:
        out += segment(0xDD, struct.pack(">H", interval))
    return out + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + bytes([0, 63, 0])) + coded + b"\xff\xd9"


def test_the_standard_tables_are_whole():
    want = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0, 0xF0}
    for counts, symbols in (baseline.AC_LUMINANCE, baseline.AC_CHROMINANCE):
        assert set(symbols) == want and len(symbols) == sum(counts) == 162
    assert baseline.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(baseline.ZIGZAG) == list(range(64))


@pytest.mark.parametrize(("n", "sampling", "tables", "interval"), [(1, ((1, 1),), True, 0), (1, ((2, 2),), False, 0), (3, ((1, 1),) * 3, True, 2), (3, ((2, 2), (1, 1), (1, 1)), False, 1), (3, ((2, 1), (1, 1), (1, 1)), False, 3)])
def test_baseline_frames(n, sampling, tables, interval):
    rng = np.random.default_rng(n)
    y, x = np.mgrid[0:32, 0:48]
    luma = np.clip(128 + 60 * np.sin(x / 7) + 40 * np.cos(y / 5) + rng.integers(-20, 20, (32, 48)), 0, 255).astype(np.uint8)
    a, d = sampling[0]
    planes = [luma] + [rng.integers(90, 160, (32 * s[1] // d, 48 * s[0] // a)).astype(np.uint8) for s in sampling[1:]]
    frame = baseline_frame(planes, sampling if n > 1 else ((1, 1),), tables, interval)
    assert np.abs(baseline.luminance(frame).astype(int) - luma).max() <= 2


def test_baseline_clips_and_large_files():
    rng = np.random.default_rng(1)
    scenes = [np.clip(rng.integers(lo, lo + 30, (16, 24)), 0, 255).astype(np.uint8) for lo in (10, 110, 210)]
    frames = [baseline_frame([s]) for s in scenes for _ in range(10)]
    n, payload, clips, error = media.analyse(media.write_avi(frames, 24, 16))
    assert (n, error) == (30, None) and [c["start_frame"] for c in clips] == [0, 10, 20] and len(payload) == 30 * 24 * 16
    # a second RIFF chunk, and frames in rec lists
    lossless = media.encode_frames(np.arange(3 * 768, dtype=np.uint8).reshape(3, 24, 32))
    first = media.write_avi(lossless[:1], 32, 24)
    rec = media._chunk(b"LIST", b"rec " + b"".join(media._chunk(b"00dc", f) for f in lossless[1:]))
    more = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + rec))
    assert media.analyse(first + more)[1] == bytes(np.arange(3 * 768, dtype=np.uint8))


def test_lists_in_lists_and_large_categories():
    x = np.arange(2 * 768, dtype=np.uint8).reshape(2, 24, 32)
    frames = media.encode_frames(x)
    body = media._chunk(b"00dc", frames[0])
    for depth in range(3000):
        body = media._chunk(b"LIST", b"rec " + body + (media._chunk(b"00dc", frames[1]) if depth == 2999 else b""))
    file = media._chunk(b"RIFF", b"AVI " + media._chunk(b"LIST", b"movi" + body))
    assert media.analyse(file)[1] == x.tobytes()
    for symbol in (16, 255):
        head = b"\xff\xd8" + media._segment(0xC3, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0])) + media._segment(0xC4, bytes([0, 2] + [0] * 15 + [0, symbol])) + media._segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
        n, payload, clips, error = media.analyse(media.write_avi([head + b"\xaa" * 4000 + b"\xff\xd9"], 8, 8))
        assert (n, payload, clips) == (None, None, []) and error


def test_odd_files_give_rows_with_errors():
    headless = b"\xff\xd8" + media._segment(0xC4, bytes([0, *media._COUNTS, *media._SYMBOLS])) + media._segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + b"\xff\xd9"
    assert media.analyse(media.write_avi([headless], 32, 24))[3] == "no frame header"
    x = np.arange(768, dtype=np.uint8).reshape(1, 24, 32)
    for note in ("payload_bytes=-5", "payload_bytes=x", "payload_bytes=99999"):
        assert media.analyse(media.write_avi(media.encode_frames(x), 32, 24, note))[1] == x.tobytes()
    good = [media.write_avi(media.encode_frames(x), 32, 24), media.write_avi([baseline_frame([x[0]])], 32, 24)]
    rng = random.Random(6)
    for i in range(600):  # damaged files: a result or an error, never an exception
        data = bytearray(good[i % 2])
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        n, payload, clips, error = media.analyse(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])]))
        assert (n is None) == (error is not None) == (payload is None)
