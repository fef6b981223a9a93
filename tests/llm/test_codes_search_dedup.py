"""Vector codes, ranked lexical search and exact dedup against brute force, with odd tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, clashing, odd, texts  # noqa: F401

from vectide.llm import exactdedup, lexical, vectorcodes

# 11


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 70), st.integers(1, 6), st.integers(1, 40), st.integers(0, 4), st.sampled_from([1, 3, 1000, 1 << 26]))
def test_filtering_finds_the_nearest_entry(k, d, n, bits, reach):
    rng = np.random.default_rng(k * d + n)
    entries, x = rng.integers(-reach, reach, (k, d), endpoint=True), rng.integers(-reach, reach, (n, d), endpoint=True)
    cells = vectorcodes.Cells(entries, bits)
    exact = ((x[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    lower, upper = cells.bounds(x)
    assert (lower <= exact).all() and (exact <= upper).all()
    at, error, refined = cells.nearest(x)
    assert (at == exact.argmin(1)).all() and (error == exact.min(1)).all() and (refined >= 1).all()


def test_filtering_refines_few_entries():
    rng = np.random.default_rng(5)
    entries, x = rng.normal(0, 40, (64, 4)).astype(int), rng.normal(0, 40, (2000, 4)).astype(int)
    assert vectorcodes.Cells(entries).nearest(x)[2].mean() < 64 / 4


def coded_by_hand(rows, parts, entries, rounds, scale):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = max(collections.Counter(len(v) for _, v, _ in kept).items(), key=lambda c: (c[1], c[0]))[0]
    width = -(-n // parts)
    kept = [(i, [math.floor(scale * x) for x in v] + [0] * (width * parts - n), lab) for i, v, lab in kept if len(v) == n]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[p])]
    out = [(i, lab, [near(v, p) for p in range(parts)]) for i, v, lab in kept]
    per_label = collections.Counter()
    for _, lab, found in out:
        per_label[lab] += sum(e for e, _ in found)
    return sorted((str(i), str(lab), bytes(j for _, j in found), sum(e for e, _ in found), per_label[lab]) for i, lab, found in out), books


@pytest.mark.parametrize("width,entries", [(8, 5), (6, 3), (3, 400)])
def test_codes_of_odd_vectors(spark, width, entries):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)], rng.choice([0, 1, None])) for i in range(200)]
    rows += [(None, [0.5] * width, 1), (7, [0.25] * width, None), (7, [0.25] * width, None), (201, None, 1), (202, [None] * width, 1), (203, [math.nan] * width, 2)]
    rows += [(204, [math.inf] + [0.0] * (width - 1), 1), (205, [1.0] * (width + 1), 1), (206, [], 1), (207, [-math.inf] * width, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = clashing(df, "code", "error", "refined", "label_error", "scaled")
    numbers = vectorcodes.scaled(df, "embedding", 4, 256)
    books = vectorcodes.fit(numbers, "vec_id", 4, entries, 2)
    got = vectorcodes.label_errors(vectorcodes.encode(numbers, books), "label").collect()
    want, want_books = coded_by_hand(rows, 4, entries, 2, 256)
    assert [b.tolist() for b in books] == want_books
    wide = lambda c: bytes(c) if entries <= 256 else bytes(np.frombuffer(bytes(c), ">u2").astype(np.uint8))
    if entries <= 256:
        assert sorted((str(r.vec_id), str(r.label), wide(r.code), r.error, r.label_error) for r in got) == want
    else:  # every row is an entry of its own, or equal to one
        assert sum(r.error for r in got) == sum(w[3] for w in want) and len(got) == len(want)


def test_codes_of_no_rows(spark):
    for rows in ([], [(1, None, 1)]):
        numbers = vectorcodes.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "embedding", 16, 256)
        books = vectorcodes.fit(numbers, "vec_id", 16, 64, 2)
        assert books == [] and vectorcodes.digest(books) is None
        assert vectorcodes.label_errors(vectorcodes.encode(numbers, books), "label").collect() == []


# 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(docs, queries, k):
    words = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, collections.Counter(w)) for d, t in docs if (w := words(t))]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1) if s < 0]
    return sorted(out, key=str)


QUERIES = [(1, "The bestOF times"), (2, None), (3, ""), (4, "word word"), (5, "漢字 ünï¢ødé x"), (6, "nowhere_else"), (7, "repeated ROW without"), (1, "cat, MAT; cat"), (None, "word")]


def test_ranking_of_odd_tables(spark, odd):  # noqa: F811
    docs, queries = clashing(odd, "rank", "score", "block", "item_id"), clashing(spark.createDataFrame(QUERIES, "item_id int, text string"), "rank", "doc_id", "place")
    got = lexical.search(lexical.build_index(docs), queries, 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand([(r[0], r[1]) for r in ODD], QUERIES, 3)


@pytest.mark.parametrize("block,run,seeds,portion", [(4, 300, 1, 200), (16, 1 << 18, 4, 4_000_000), (1, 1, 2, 50)])
def test_ranking_is_exact(spark, monkeypatch, block, run, seeds, portion):
    for name, value in (("BLOCK_DOCS", block), ("RUN_POSTINGS", run), ("SEEDS", seeds), ("QUERY_BYTES", portion)):
        monkeypatch.setattr(lexical, name, value)
    made = texts(120, 3, (1, 60))
    rows = [(i, t) for i, t in enumerate(made + made[:15] + made[:3] * 4)]  # ties among copies
    queries = [(i, made[i][:80]) for i in range(0, 20)] + [(90, " ".join(made[:2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lexical.search(lexical.build_index(docs), spark.createDataFrame(queries, "item_id int, text string"), 10)
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(rows, queries, 10)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    rng = random.Random(1)
    rows = [(i, f"common{i % 7} filler " * 3 + " ".join(f"w{rng.randrange(400)}" for _ in range(10))) for i in range(400)] + [(1000 + i, "needle in the hay") for i in range(12)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    portion = lexical._Portion(spark.createDataFrame([(0, b"needle in the common1 filler")], "place long, text binary").collect())
    assert [r.id for r in lexical._portion_rows(index, portion, 10).orderBy("rank").collect()] == list(range(1000, 1010))
    # the bounds of the other blocks stay below the tenth score
    scores = [r.score for r in lexical._portion_rows(index, portion, 10).collect()]
    open_ = [portion.bounds(portion.numbers(b.column(1))[i], np.array(b.column(2)[i].as_py()))[0] >= min(scores) for b in index.blocks.select("block", "terms", "most").toArrow().to_batches() for i in range(b.num_rows)]
    assert sum(open_) < len(open_) / 10


def test_ranking_of_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    none = docs.where("false")
    assert lexical.search(lexical.build_index(none), queries).collect() == []
    assert lexical.search(lexical.build_index(none.unionAll(spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string"))), queries).collect() == []
    assert lexical.search(lexical.build_index(docs), queries.where("false")).collect() == []


# 13


def kept_by_hand(rows, content=lambda t: t or ""):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[content(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), bool(left and i == keep), hashlib.sha256(t.encode()).hexdigest()))
            left = 0
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string"), lambda c: F.lit("same")])
def test_exact_duplicates_of_odd_tables(spark, odd, digest):  # noqa: F811
    rows = [(r[0], r[1]) for r in ODD]
    got = exactdedup.exact_duplicates(clashing(odd, "keep_id", "kept", "digest", "content", "n"), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and rows_of(got) == kept_by_hand(rows)
    assert exactdedup.exact_duplicates(odd.where("false")).collect() == []


def test_hot_contents_and_normalised_texts(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Hot  text", "hot text", f"own {i // 2}", None, ""])) for i in range(4000)] + [(None, "hot text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(exactdedup.exact_duplicates(docs, salts=3)) == kept_by_hand(rows)
    plain = lambda t: re.sub(" +", " ", (t or "").lower())
    same = exactdedup.exact_duplicates(docs, normalise=lambda c: F.regexp_replace(F.lower(c), " +", " "))
    assert rows_of(same) == kept_by_hand(rows, plain)


def test_whole_rows_stay(spark, odd):  # noqa: F811
    docs = clashing(odd.union(spark.createDataFrame([(9, "", "x", "y", 7), (9, None, "x", "z", 7)], SCHEMA)), "digest", "salt")
    got = exactdedup.deduplicated(docs)
    assert got.columns == docs.columns
    kept = {(r.doc_id, r.text): r.source for r in got.collect()}
    texts_ = {t or "" for _, t, *_ in ODD}
    assert len(kept) == len(texts_) and kept[9, ""] == "y" and (None, "Repeated row without an id") in kept


def test_a_run_holds_numbers_of_terms():
    """A run of documents takes some bytes a posting (before, a dictionary of terms each: over 100)."""
    import tracemalloc

    texts = [" ".join(f"word{(i * 7 + j * 13) % 5000}" for j in range(500)).encode() for i in range(300)]
    known = {}
    tracemalloc.start()
    held = [lexical._counted(t, known) for t in texts]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert lexical._counted(b" .,", known) is None
    names = list(known)
    assert {names[n].decode(): f for n, f in zip(held[3][1], held[3][2])} == {w: 1 for w in texts[3].decode().split()}
    assert size / sum(len(n) for _, n, _ in held) < 24


def test_blocks_are_packed(spark):
    """A term of a document takes two numbers of one byte each, or of more where a block needs them (before: arrays, of which Spark's readers hold 12 bytes or more for each number)."""
    some, often = [(i, " ".join(f"w{(i + j) % 200}" for j in range(100))) for i in range(16)], [(99, "rare " + "often " * 70_000 + "seldom " * 300)]
    for rows, wide in ((some, 1), (often, 4)):
        index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        (block,) = index.blocks.selectExpr("ends[size(ends) - 1] as n", "octet_length(at) as at", "octet_length(tf) as tf", "octet_length(df) as df", "size(most) as terms").collect()
        assert (block.at, block.tf, block.df) == (block.n, wide * block.n, block.terms)
        queries = [(1, "w3 w150 often"), (2, "rare seldom w7")]
        got = lexical.search(index, spark.createDataFrame(queries, "item_id int, text string"), 10)
        assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(rows, queries, 10)
