"""Personal data: patterns, and a skip-chain conditional random field that finds what they leave out.

The patterns find emails, IP addresses, card numbers and phone numbers; their spans always stay.
In every text the tokens that may be part of personal data (they hold a digit or ``@``, or are an
email spelled out with "at" and "dot"), and the key names (``token =``, ``api_key:``) become the
variables of a conditional random field with the labels none, email, ip, card, phone, secret and key.
Tokens in a pattern's span and key names are observed.
Neighbouring tokens share chain potentials.  Tokens that repeat or resemble each other anywhere in
the text share skip potentials, which favour equal labels: the same letters and digits, the same
last seven digits, or the same last four digits where the rest is masked.  Sum-product messages run
over this loopy graph until they settle.

A token has a label where its probability is ``SURE`` or more.  Neighbouring phone tokens make one
span.  A span is added if it is whole (``whole``: digits of a full number, four groups of an
address, and so on), or if skip links join it to a token that is part of a span of the same kind.
So the field finds numbers that a pattern lost because it ran into the next number, addresses and
emails in altered spelling, secrets after a key name, and parts and repeats of all these.

What a secret looks like, a long mix of letters and digits, is what a checksum looks like too.  Only
those after a key name are known, so no share of secrets among the others can be learnt: by itself
such a token is never held to be a secret rather than none (``alone``).  The key name
speaks through the chain, and a repeat elsewhere in the text through its skip links; without these
messages no secret is found.

``fit`` learns the weights from all documents, with the patterns' matches as labels, and as secrets
the long mixed tokens next to a key name; other mixed tokens are unlabelled.  Token features are learnt by multinomial
logistic regression, chain and skip weights from counts.  A token that no pattern matched but skip
links join to a matched one counts as unlabelled, not as none.  Of each email, address and card
a copy in altered spelling is learnt too.  All this needs only counts of feature sets, label pairs and links:
a task sums them up, so a fit shuffles and collects a small table however many documents there are
(a row for each set of features that occurs; ``_MASKS`` at most, usually some dozens).

Both passes work text by text, whole in one task, and shuffle no text.

Nulls and odd input.  A null text has no spans.  Places are code points, the end exclusive.
Repeated rows get equal spans.  An empty table gives no rows and default weights.  Columns of the
input pass through; one that is named ``spans``, like the added one, is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import cleared

#: The patterns' kinds; the field adds one more.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELS = ("none", *ALL_KINDS, "key")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
KEY = len(LABELS) - 1
SURE = 0.9
#: Links that are taken to agree before any is seen; one is taken to disagree.
ALIKE = 20
#: Neighbours of each label that are added to those seen, labelled as by chance; what a neighbour may weigh, at least and at most.
SMOOTH, CHAIN = 1.0, (-2.0, 3.0)
ROUNDS, DAMPING, SETTLED = 30, 0.5, 1e-4

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()),
]))

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """What the email pattern matches, leftmost first, in one pass over the ``@``s."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


_CORE = "()[]{}<>,;:!?\"'`#*$%&|=."
_MIXED = re.compile(r"[A-Za-z0-9_+/-]{16,}")
_KEY_NAME = re.compile(r"[\"'`({\[]*[\w.-]*(?:token|secret|passw(?:or)?d|pwd|credential|bearer|auth|api.?key|access.?key|private.?key)\w*[\"'`]?(?P<given>[=:]+(?P<value>\S*))?", re.IGNORECASE)
_KEY_HINT = re.compile(r"token|secret|passw|pwd|credential|bearer|auth|key", re.IGNORECASE)
_GIVEN = re.compile(r"\s*[=:]")
_SEVEN = re.compile(r"(?<![0-9])[0-9]{3}[-.][0-9]{4}(?![0-9])")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+\s*(?:\(at\)|\[at\]|\{at\}|\sat\s|@)\s*[A-Za-z0-9-]+(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s*[A-Za-z0-9-]+)+", re.IGNORECASE
)
_WORDY = re.compile(r"\s(?:at|dot)\s", re.IGNORECASE)
#: Common top-level domains.  An email spelled out in bare words must end in one.
DOMAINS = frozenset("com org net edu gov mil int info io co dev app ai eu uk us ca au de fr es it nl ch at se no pl br jp cn in ru".split())
_AT, _DOT = re.compile(r"\s*(?:[(\[{]at[)\]}]|\sat\s)\s*", re.IGNORECASE), re.compile(r"\s*(?:[(\[{]dot[)\]}]|\sdot\s)\s*", re.IGNORECASE)
_MASKED = re.compile(r"\*\*|xx|XX")
_FENCED = re.compile(r"[\[({]\.[\])}]")

#: What a token's features say; a token's set of them is a bit mask.
FEATURES = (
    "always", "at", "domain", "four groups", "no digit", "1-4 digits", "5-9 digits", "10-13 digits", "14-19 digits", "check digit",
    "plus", "bracket", "seven digits", "letter", "mixed", "altered", "masked",
)
#: A bound of the sets that can occur: five digit classes, and all else free.
_MASKS = 6 * 2 ** (len(FEATURES) - 6)


def features(token: str, digits: str) -> int:
    """The bit mask of a token's features."""
    n = len(digits)
    core = token.strip(_CORE)
    plain = _FENCED.sub(".", core)
    parts = plain.split(".")
    letters = any(c.isalpha() for c in core)
    masked = n >= 4 and _MASKED.search(token) is not None
    found = (
        True,
        "@" in token,
        "@" in token and "." in token.rpartition("@")[2].strip(_CORE),
        len(parts) == 4 and all(p.isdecimal() and p.isascii() and small(p) for p in parts),
        n == 0,
        1 <= n <= 4 and not masked,
        5 <= n <= 9,
        10 <= n <= 13,
        14 <= n <= 19,
        14 <= n <= 19 and luhn(digits),
        token.startswith("+"),
        "(" in token or ")" in token,
        bool(_SEVEN.search(core)),
        letters,
        letters and n > 0 and "@" not in token and bool(_MIXED.fullmatch(core)) and len(set(core.lower())) >= 8,
        plain != core,
        masked,
    )
    return sum(1 << i for i, f in enumerate(found) if f)


def _bits(*names: str) -> int:
    return sum(1 << FEATURES.index(name) for name in names)


#: Emails spelled out, and the altered copies that are learnt beside each observed email, address and card.
SPELLED = _bits("always", "at", "domain", "no digit", "letter", "altered")
ALTERED = {EMAIL + 1: SPELLED, IP + 1: _bits("always", "four groups", "10-13 digits", "altered"), CARD + 1: _bits("always", "masked")}
_SECRET = _bits("mixed")


@dataclass
class Graph:
    """The tokens of a text: places, numbers, feature masks, observed labels, chain and skip links."""

    at: list[tuple[int, int]] = field(default_factory=list)
    x: list[int] = field(default_factory=list)
    y: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    number: list[int] = field(default_factory=list)


def spelled_emails(text: str) -> list[tuple[int, int]]:
    lower = text.lower()
    if "dot" not in lower or ("at" not in lower and "@" not in lower):
        return []
    return [m.span() for m in _SPELLED.finditer(text) if not _WORDY.search(m[0]) or m[0].split()[-1].lower() in DOMAINS]


def may_hold(text: str) -> bool:
    return _DIGIT.search(text) is not None or "@" in text or bool(spelled_emails(text))


def keys_of(token: str, digits: str) -> set[str]:
    """Tokens that share a key are alike."""
    token = _DOT.sub(".", _AT.sub("@", token))
    keys = {"=" + "".join(c for c in token.lower() if c.isalnum() or c == "@")}
    if len(digits) >= 7:
        keys.add("7" + digits[-7:])
    if len(digits) >= 14 or (len(digits) >= 4 and _MASKED.search(token)):
        keys.add("masked" + digits[-4:])
    return {k for k in keys if len(k) > 3}


def key_name(token: str, text: str, end: int) -> int | None:
    """If the token is a key name that something is assigned to: how many of its characters are before the value."""
    m = _KEY_NAME.match(token)
    if m is None or (m["given"] is None and (m.end() < len(token) or not _GIVEN.match(text, end))):
        return None
    return len(token) if m["given"] is None else m.start("value")


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    g, last_of, k, before = Graph(), {}, 0, None
    spelled, s = spelled_emails(text), 0
    named = _KEY_HINT.search(text) is not None
    for number, m in enumerate(_TOKEN.finditer(text)):
        start, end = m.span()
        while s < len(spelled) and spelled[s][1] <= start:
            s += 1
        if altered := s < len(spelled) and start < spelled[s][1] and end > spelled[s][0]:
            if g.at and g.at[-1] == spelled[s]:
                continue  # a later token of the same spelled email
            start, end = spelled[s]
        token = text[start:end]
        if named and not altered and _KEY_HINT.search(token) and (cut := key_name(token, text, end)) is not None:
            _link(g, (start, start + cut), _bits("always"), KEY, number, before)
            before, start, token = number, start + cut, token[cut:]
        if not altered and "@" not in token and not _DIGIT.search(token):
            continue
        i, digits = len(g.at), _NO_DIGITS.sub("", token)
        while k < len(base) and base[k][2] <= start:
            k += 1
        label = next((b[1] + 1 for b in base[k : k + 8] if b[0] < end and b[2] > start), 0)
        _link(g, (start, end), SPELLED if altered else features(token, digits), label, number, before)
        before = number
        for key in keys_of(token, digits):
            if key in last_of:
                g.skip.append((last_of[key], i))
            last_of[key] = i
    g.skip = sorted(set(g.skip))
    return g


def _link(g: Graph, at: tuple[int, int], x: int, y: int, number: int, before: int | None) -> None:
    """One more token, in a chain with the last one where that is the one before or before that."""
    if before is not None and number - before <= 2:
        g.chain.append((len(g.at) - 1, len(g.at)))
    g.at.append(at)
    g.x.append(x)
    g.y.append(y)
    g.number.append(number)


def tops(g: Graph) -> list[int]:
    """For each token the first token that skip links join it to."""
    parent = list(range(len(g.x)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in g.skip:
        a, b = top(i), top(j)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(parent))]


@dataclass
class Weights:
    """Log potentials: token features by label, neighbours by label pair, and equal labels of skip links."""

    unary: list[list[float]]
    chain: list[list[float]]
    skip: float


def default_weights() -> Weights:
    return Weights([[0.0] * len(LABELS) for _ in FEATURES], [[0.0] * len(LABELS) for _ in LABELS], 2.0)


def observations(g: Graph) -> Iterator[tuple[str, int, int]]:
    """What a text's graph teaches: ("token", mask, label), ("chain", label, label) and ("skip", 0, alike)."""
    after_key = {j for i, j in g.chain if g.y[i] == KEY}
    y = [v or (SECRET + 1 if x & _SECRET and i in after_key else 0) for i, (x, v) in enumerate(zip(g.x, g.y))]
    top = tops(g)
    known = {t for t, v in zip(top, y) if v}
    for x, v, t in zip(g.x, y, top):
        if v != KEY and (v or (t not in known and not x & _SECRET)):
            yield "token", x, v
        if v in ALTERED:
            yield "token", ALTERED[v], v
    for i, j in g.chain:
        yield "chain", y[i], y[j]
    for i, j in g.skip:
        if y[i] and y[j]:
            yield "skip", 0, int(y[i] == y[j])


def unpacked(masks: list[int]):
    """Feature masks as rows of 0 and 1."""
    import numpy as np

    return (np.array(masks, np.int64).reshape(-1, 1) >> np.arange(len(FEATURES)) & 1).astype(float)


def learn(counts: dict[tuple[str, int, int], int], steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> Weights:
    """Weights from how often each of the ``observations`` occurs."""
    import numpy as np

    n = len(LABELS)
    used = sorted((mask, label, c) for (kind, mask, label), c in counts.items() if kind == "token")
    if not used:
        return default_weights()
    x, y = unpacked([m for m, _, _ in used]), np.array([v for _, v, _ in used])
    share = np.array([c for _, _, c in used], float)
    # rare labels and frequent ones teach alike: the root of a label's count is its weight
    totals = np.bincount(y, share, n)
    share /= np.sqrt(totals[y])
    share /= share.sum()
    target, w, moment = np.eye(n)[y], np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
    for _ in range(steps):
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        moment = 0.9 * moment + x.T @ ((target - p) * share[:, None]) - decay * w
        w += rate * moment
    pairs = np.zeros((n, n))
    for (kind, a, b), c in counts.items():
        if kind == "chain":
            pairs[a, b] += c
    # how much oftener a label follows another one than it occurs at all; few pairs say little
    at_all = np.maximum(np.bincount(y, [c for *_, c in used], n), pairs.sum(0)) + 1
    at_all /= at_all.sum()
    chain = np.log((pairs + SMOOTH * at_all) / (pairs.sum(1, keepdims=True) + SMOOTH) / at_all)
    chain[0] = 0.0  # a token of no kind says nothing of the next one
    alike, unlike = counts.get(("skip", 0, 1), 0), counts.get(("skip", 0, 0), 0)
    skip = float(np.log((alike + ALIKE) / (unlike + 1)) + np.log(n - 1))
    return Weights(w.tolist(), np.clip(chain, *CHAIN).tolist(), max(1.0, min(skip, 5.0)))


def alone(g: Graph, w: Weights):
    """Log potentials of each token by itself; a mixed token is as likely none as it is a secret, at least."""
    import numpy as np

    out = unpacked(g.x) @ np.array(w.unary)
    mixed = np.array(g.x) & _SECRET > 0
    out[mixed, 0] = np.maximum(out[mixed, 0], out[mixed, SECRET + 1])
    out[:, KEY] = -30.0  # key names are observed
    return out


def marginals(g: Graph, w: Weights):
    """Label probabilities of each token, by damped sum-product messages; tokens in pattern spans are observed."""
    import numpy as np

    k = len(LABELS)
    unary = alone(g, w)
    y = np.array(g.y)
    seen = y > 0
    unary[seen] = -30.0
    unary[seen, y[seen]] = 0.0
    unary -= unary.max(axis=1, keepdims=True)
    if not g.chain and not g.skip:
        p = np.exp(unary)
        return p / p.sum(axis=1, keepdims=True)
    # two tokens that are neighbours and alike share one table, the product of both
    near, alike = set(g.chain), set(g.skip)
    chain, skip = np.exp(np.array(w.chain)), np.exp(w.skip * np.eye(k))
    edges = np.array(sorted(near | alike), int)
    kind = [(e in near) + 2 * (e in alike) for e in map(tuple, edges.tolist())]
    tables = np.stack([np.ones((k, k)), chain, skip, chain * skip])[kind]
    source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, goal, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, tables))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, goal, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def whole(kind: int, text: str) -> bool:
    """Whether a text is all of an item of a kind, and not only a part of one."""
    n = len(_NO_DIGITS.sub("", text))
    if kind == EMAIL:
        return bool(_SPELLED.fullmatch(text)) or bool(emails(text))
    if kind == IP:
        return len(parts := _FENCED.sub(".", text).split(".")) == 4 and all(p.isdecimal() and small(p) for p in parts)
    if kind == CARD:
        return 14 <= n <= 19
    return 10 <= n <= 15 if kind == PHONE else len(text) >= 16


def decode(text: str, g: Graph, p) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of tokens beside the patterns' from the label probabilities."""
    top = tops(g)
    label = [y or (int(q.argmax()) if q.max() >= SURE else 0) for y, q in zip(g.y, p)]
    runs: list[list[int]] = []
    for i, v in enumerate(label):
        if not v or g.y[i]:
            continue
        last = runs[-1][-1] if runs else None
        more = last is not None and last == i - 1 and label[last] == v == PHONE + 1 and g.number[i] == g.number[last] + 1 and text[g.at[i][0]] != "+"
        if more:
            runs[-1].append(i)
        else:
            runs.append([i])
    found, known = [], {(t, y) for t, y in zip(top, g.y) if y}
    for run in runs:
        kind, (a, b) = label[run[0]] - 1, (g.at[run[0]][0], g.at[run[-1]][1])
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            complete = whole(kind, text[a:b])
            found.append((a, kind, b, complete, {top[i] for i in run}))
            if complete:
                known |= {(top[i], kind + 1) for i in run}
    return [(a, kind, b) for a, kind, b, complete, ts in found if complete or any((t, kind + 1) in known for t in ts)]


def added_spans(text: str, base: list[tuple[int, int, int]], w: Weights) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) beside the patterns' that the field gives."""
    g = graph_of(text, base)
    return [] if all(g.y) else decode(text, g, marginals(g, w))


def find_spans(text: str, w: Weights) -> list[tuple[int, int, int, bool]]:
    if not may_hold(text):
        return []
    base = base_spans(text)
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, w)])


def fit(df: DataFrame, text_col: str = "text") -> Weights:
    """Weights from counts over all of df's texts."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                if (text := t.as_py()) and may_hold(text):
                    counts.update(observations(graph_of(text, base_spans(text))))
        rows = [(*key, n) for key, n in sorted(counts.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "a", "b", "n"])

    sums = df.select(text_col).mapInArrow(run, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return learn({(r.kind, r.a, r.b): r.n for r in sums.collect()})


def tag(df: DataFrame, weights: Weights | None = None, text_col: str = "text") -> DataFrame:
    """df with ``spans``: kind, start, end and whether a pattern gave it; by start, then kind."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = cleared(df, "spans")
    weights = weights or fit(df, text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("spans", SPANS)])
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_schema(schema).field("spans").type
        for batch in batches:
            rows = [[{"kind": ALL_KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in find_spans(t.as_py() or "", weights)] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])

    return df.mapInArrow(run, schema)
