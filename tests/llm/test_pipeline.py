"""The pipeline's stages against plain Python versions, on a small corpus with planted cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from test_operators import ODD, SCHEMA, WORD, components, library, slow_dedup  # noqa: F401

import corpus_pipeline as P
from vectide.llm import quality, simhash

COMMON = quality.COMMON_WORDS["en"]


def corpus():
    rng = random.Random(12)
    rare = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    sentence = lambda: " ".join(rng.choice(COMMON) if rng.random() < 0.45 else rng.choice(rare) for _ in range(12)) + "."
    docs = ["\n".join(sentence() for _ in range(rng.randint(10, 20))) for _ in range(60)]
    passage = "\n".join(sentence() for _ in range(6))
    rows = list(docs)
    rows += docs[:5]  # exact copies
    for t in docs[5:15]:  # near copies: a word of each third line changed
        lines = t.split("\n")
        for k in range(0, len(lines), 3):
            w = lines[k].split(" ")
            w[5] = "changed"
            lines[k] = " ".join(w)
        rows.append("\n".join(lines))
    for t in docs[20:25]:  # near copies whose lines all differ a little
        rows.append("\n".join(x + (" more" if k % 2 else " still") for k, x in enumerate(t.split("\n"))))
    for _ in range(6):  # long lines, and copies of them that all differ by a word at their end
        lines = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
        rows += ["\n".join(lines), "\n".join(x + " more" for x in lines), "\n".join(x + " still" for x in lines)]
    for i in range(4):  # a shared passage in new documents
        rows.append("\n".join(sentence() for _ in range(8)) + "\n" + passage + "\n" + sentence())
    rows += ["\n".join("### $$$ %%% ZQ&&& ***" * 1 for _ in range(60)) + f" {i}" for i in range(3)]
    return [(i, t, "en", "a" if i % 3 else "b", len(t)) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    path = str(base / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    out = [spark.read.parquet(path)]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], str(base)).write.parquet(str(base / f"{i}"))
        out.append(spark.read.parquet(str(base / f"{i}")))
    assert P.run(spark, str(base)).count() == out[-1].count()
    return [sorted(map(tuple, df.select(*(P.COLUMNS if i < 5 else df.columns)).collect()), key=str) for i, df in enumerate(out)]


def divergence(a, b):
    p, q = np.array(a, float) / sum(a), np.array(b, float) / sum(b)
    m = (p + q) / 2
    part = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_quality(stages):
    def histograms(t):
        w = WORD.findall(t)
        s = "".join(w)
        classes = ["[a-z]", "[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", "[#*$%&|<>]", "[ß-ÿ]"]
        chars = [len(re.findall(c, s)) for c in classes]
        words = collections.Counter(w)
        return w, [*chars, len(s) - sum(chars)], [*(words[c] for c in COMMON), len(w) - sum(words[c] for c in COMMON)]

    made = [(r, *histograms(r[1])) for r in stages[0]]
    refs = [np.sum([m[k] for m in made], axis=0) for k in (2, 3)]
    kept = []
    for r, w, chars, words in made:
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        bad = len(w) < 20 or 100 * repeated > 30 * len(w)
        by_chance = lambda k: (k - 1 + 3 * math.sqrt(2 * (k - 1))) / (8 * len(w) * math.log(2))  # noqa: B023, E731
        if len(w) >= quality.MIN_WORDS and (divergence(chars, refs[0]) > 0.13 + math.sqrt(by_chance(7)) or divergence(words, refs[1]) > math.sqrt(0.1**2 + by_chance(len(words)))):
            bad = True
        if not bad:
            kept.append(r)
    assert sorted(kept, key=str) == stages[1] and len(kept) == len(stages[0]) - 3


def test_lines(stages):
    rows = sorted(stages[1])
    texts = slow_dedup([(r[0], r[1]) for r in rows], 50)
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts) if not (r[1] and t == "")]
    assert sorted(want, key=str) == stages[2]
    assert len(stages[2]) == len(stages[1]) - 5  # the exact copies


def test_near_copies(stages):
    rows = sorted(stages[2])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = components(len(rows), links)
    assert len(links) >= 12 and sorted((r for i, r in enumerate(rows) if label[i] == i), key=str) == stages[3]


def test_near_copies_of_a_whole_table(spark):
    """All links of the exact similarity between all documents at sf0.01, by an inverted list."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.similar_duplicates(docs, "text", "doc_id", P.SHINGLE, P.SIMILARITY, P.RADIUS, P.BITS // 64).collect()}
    rows = sorted(docs.collect())
    sets = [set(simhash._hashes(r.text, P.SHINGLE)) for r in rows]
    holders, links = collections.defaultdict(list), []
    for j, s in enumerate(sets):
        shared = collections.Counter(i for h in s for i in holders[h])
        links += [(i, j) for i, n in shared.items() if n >= P.SIMILARITY * (len(sets[i]) + len(s) - n)]
        for h in s:
            holders[h].append(j)
    none = [j for j, s in enumerate(sets) if not s]
    label = components(len(rows), links + list(zip(none, none[1:])))
    assert got == {r.doc_id: rows[c].doc_id for r, c in zip(rows, label)}


def test_mixture(stages):
    counts = collections.Counter(r[3] for r in stages[3])
    roots, n = {s: math.sqrt(c) for s, c in counts.items()}, len(stages[3])
    want = collections.Counter()
    for r in stages[3]:
        rate = roots[r[3]] / sum(roots.values()) * n / counts[r[3]]
        digest = hashlib.md5(f"9:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        u, k, p = int(digest[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r] += k
    assert collections.Counter(stages[4]) == +want


def test_ids(stages, library):  # noqa: F811
    want = sorted(((r[0], r[3], len(ids := library.encode_ordinary(r[1])), ids, True) for r in stages[4]), key=str)
    assert stages[5] == want


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_and_empty_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", shard int, words string")
    for i, (_, stage) in enumerate(P.STAGES):
        alone = str(tmp_path / f"alone{i}")
        spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", shard int, words string").write.parquet(alone)
        out = stage(spark, spark.read.parquet(alone), str(tmp_path))
        assert out.columns == (list(P.COLUMNS) if i < 4 else ["doc_id", "source", "n_tokens", "ids", "intact"])
        assert out.count() <= 3 * max(1, df.count())
