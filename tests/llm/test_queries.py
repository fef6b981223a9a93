"""The registered queries over a whole table: against their SQL, or the contract by plain Python."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import components, exact_marginals, library, plain_spans, slow_fingerprint  # noqa: F401
from tokenizers import Tokenizer

from vectide.llm import media, pii, queries
from vectide.llm.tokenizing import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def result(spark, name, *columns, sf=SF):
    return {r.doc_id: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=str)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_shards(spark, docs):
    got = result(spark, "op1_sharding", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert {d: v[:3] for d, v in got.items()} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for d, t in docs}
    by = collections.defaultdict(list)
    for v in got.values():
        by[v[3]].append(v[4])
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {v[5] for v in got.values()} == {None}


def test_bpe(spark, docs, library):  # noqa: F811
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in docs}
    assert result(spark, "op2_byte_level_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_counts(spark, docs, library):  # noqa: F811
    assert result(spark, "op3_token_counts", "n_tokens", "ended") == {d: (len(library.encode_ordinary(t or "")), True) for d, t in docs}


def test_private_data(spark, docs):
    want = {}
    for d, t in docs:
        spans = plain_spans(t or "")
        n = collections.Counter(k for _, k, _ in spans)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[d] = (*(n[k] for k in range(4)), hashlib.sha256(text.encode()).hexdigest())
    assert result(spark, "op5_pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_spans_of_the_field(spark, duck):
    sf = "/root/testdata/sf0.01"
    docs = duck.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    counts, want, added = collections.Counter(), {}, 0
    graphs = {d: (t or "", plain_spans(t or ""), pii.graph_of(t or "", plain_spans(t or ""))) for d, t in docs}
    for _, _, g in graphs.values():
        counts.update(pii.observations(g))
    weights = pii.learn(counts)
    for d, (t, base, g) in graphs.items():
        p = exact_marginals(g, weights) if len(g.at) <= 5 else pii.marginals(g, weights)
        more = [] if all(g.y) else pii.decode(t, g, p)
        added += len(more)
        want[d] = (",".join(f"{pii.ALL_KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more)), len(base) + len(more), len(more))
    assert result(spark, "op5_pii", "spans", "n_spans", "n_added", sf=sf) == want
    # all planted secrets, and no number that fails the check digits
    secrets = {(d, m.start(1)) for d, t in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.IGNORECASE)}
    found = {(d, int(s.split(":")[1])) for d, v in want.items() for s in v[0].split(",") if s.startswith("secret")}
    assert added and secrets == found


def test_fingerprints(spark, docs):
    fp = [slow_fingerprint(t) for _, t in docs]
    label = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert result(spark, "op6_simhash_near_dedup", "fingerprint", "component_id") == {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fp, label)}


def test_token_files(spark, docs):
    tok, want, start = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {}, 0
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert result(spark, "op7_token_id_binary_output", "start", "n_tokens", "ids_crc32") == want


def plain_feature(payload):
    """Frames, shots and first frames: a shot ends where the histogram changes by far more than just before."""
    payload += b" " * (-len(payload) % 768)  # whole frames of 32 x 24
    frames = [payload[i : i + 768] for i in range(0, len(payload), 768)]
    shares = []
    for f, g in zip(frames, frames[1:]):
        a, b = (collections.Counter(v // 16 for v in x) for x in (f, g))
        shares.append(sum(abs(a[c] - b[c]) for c in range(16)) / (2 * len(f)))
    starts = [0]
    for t, d in enumerate(shares):
        before = shares[max(0, t - 8) : t]
        if before and d > 0.25 and t + 1 - starts[-1] >= 4:
            mean = sum(before) / len(before)
            spread = max(0.0, sum(v * v for v in before) / len(before) - mean * mean) ** 0.5
            if d > mean + 3 * spread:
                starts.append(t + 1)
    return f"frames={len(frames)};shots={len(starts)};starts={','.join(map(str, starts))}"


def test_media_features(spark, docs):
    got = result(spark, "op10_media_columns", "feature")
    assert {d: plain_feature(media.pad_payload((t or "").encode())) for d, t in docs} == {d: v[0] for d, v in got.items()}


def test_media(spark, docs):
    want = {}
    for d, t in docs:
        raw = (t or "").encode()
        p = media.pad_payload(raw)
        m = media.payload_to_avi(p)
        want[d] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest())
    assert result(spark, "op10_media_columns", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == want
