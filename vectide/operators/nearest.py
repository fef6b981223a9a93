"""The k nearest of many rows for many queries, inside a task: a coarse matrix product, then the exact scores of the few pairs it leaves.

The product, in 32 bits, is off by no more than a bound that follows from the norms.  A pair is passed
over only if it is farther than the query's k-th so far by more than that bound; all others get
the score that ``search.raw_scores`` gives, summed from the first dimension on.  So the result is that
of scoring all pairs, ties by id included.  Odd numbers (not finite, huge, or near zero for cosine)
are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from vectide.functions import metrics

#: Queries and rows of one product, and candidate pairs that are scored at once (what a core's cache holds).
QUERIES, ROWS, SLICE = 256, 2048, 1024
#: Rows of the first step, after which each step takes as many as were seen.
FIRST, MOST = 256, 8192
#: Pairs that may wait to be taken.
PAIRS = 2_000_000
#: Metrics that have a coarse form; the others are scored in full.
COARSE = ("euclidean", "dot", "cosine")
_UNIT, _HUGE, _SMALL = 2.0**-24, 1e30, 1e-6


def _fold(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows of (pairs, d), from the first dimension on."""
    out = np.zeros(len(terms))
    for j in range(terms.shape[1]):
        out += terms[:, j]
    return out


class Nearest:
    """The ``k`` nearest rows of each of ``queries`` (n, d) over all that is added; ids are integers.

    ``raw`` orders by raw scores (``metrics.score``) instead of distances.  ``within`` bounds the
    distances; ``distinct`` keeps each id once a query.  ``weights`` (with metric ``"dot"``) are factors of
    the queries, as are those of ``add`` of the rows: the score is then the clamped ``dot * weight * weight``.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, raw: bool = False, within: float = np.inf, distinct: bool = False, weights: np.ndarray | None = None):
        from vectide.operators.search import _norms

        self.q, self.k, self.metric, self.raw, self.distinct, self.weights = queries, k, metric, raw, distinct, weights
        self.up = metrics.ascending(metric)
        self.edge = np.full(len(queries), float(within))
        self.at, self.id, self.key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.seen = 0, 0
        self.sure: np.ndarray | None = None
        with np.errstate(all="ignore"):
            self.squared = _norms(queries)
            coarse, odd = self._coarse(queries, self.squared, weights)
        self.plain, self.odd = np.flatnonzero(~odd), np.flatnonzero(odd)
        self.size = np.where(odd, 0.0, np.square(coarse).sum(1))
        left = coarse[self.plain]
        if metric == "euclidean":
            left = np.concatenate([2 * left, np.full((len(left), 1), -1.0)], axis=1)
        self.left = left.astype(np.float32)

    def _coarse(self, v: np.ndarray, squared: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The vectors whose inner products order the pairs, and which of them must be scored in full."""
        if self.metric not in COARSE:
            return v, np.ones(len(v), bool)
        odd = ~(squared < _HUGE)
        if weights is not None:
            v = v * weights[:, None]
        elif self.metric == "cosine":
            odd |= ~(squared > _SMALL)
            v = v / np.sqrt(np.where(odd, 1.0, squared))[:, None]
        return v, odd | ~(np.square(v).sum(1) < _HUGE)

    # exact keys: the smaller, the nearer

    def _keys(self, raw: np.ndarray) -> np.ndarray:
        if self.raw:
            return raw if self.up else -raw
        return {"euclidean": np.sqrt, "cosine": lambda s: 1.0 - s, "dot": np.negative}.get(self.metric, lambda s: s)(raw)

    def _dense(self, q_at: np.ndarray, x: np.ndarray, squared: np.ndarray | None, weights: np.ndarray | None) -> np.ndarray:
        from vectide.operators.search import raw_scores

        s = raw_scores(self.q[q_at], x, self.metric, squared)
        return self._keys(s if self.weights is None else np.clip(s * self.weights[q_at][:, None] * weights[None], -1.0, 1.0))

    def _exact(self, q_at: np.ndarray, x: np.ndarray, at: np.ndarray, squared: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(0, len(at), SLICE):
            q, r = q_at[i : i + SLICE], at[i : i + SLICE]
            if self.metric == "euclidean":
                s = _fold(np.square(self.q[q] - x[r]))
            else:
                s = _fold(self.q[q] * x[r])
                if self.weights is not None:
                    s = np.clip(s * self.weights[q] * weights[r], -1.0, 1.0)
                elif self.metric == "cosine":
                    below = np.sqrt(self.squared[q] * squared[r])
                    s = np.where(below > metrics.ULP, np.clip(s / np.where(below > metrics.ULP, below, 1.0), -1.0, 1.0), 0.0)
            out[i : i + SLICE] = self._keys(s)
        return out

    def add(self, x: np.ndarray, ids: np.ndarray, squared: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        """Rows (n, d) with their ids; ``squared`` are hinted squared norms, NaN where there is no hint."""
        from vectide.operators.search import _norms

        if not self.k or not len(self.q):
            return
        done = 0
        while done < len(x):
            step = min(MOST, max(FIRST, self.seen))
            part = slice(done, min(len(x), done + step))
            rows, names = x[part], np.asarray(ids[part], np.int64)
            hint, factors = None if squared is None else squared[part], None if weights is None else weights[part]
            with np.errstate(all="ignore"):
                if hint is None:
                    known = _norms(rows)
                else:
                    known = np.where(np.isnan(hint), _norms(rows), hint)
                self._step(rows, names, known, hint, factors)
            self._settle(self.seen == 0 or self.waiting >= len(self.id))
            self.seen += len(rows)
            done += len(rows)

    def _step(self, x, ids, known, hint, weights) -> None:
        coarse, odd = self._coarse(x, known, weights)
        if odd.any():
            self._in_full(np.arange(len(self.q)), np.flatnonzero(odd), x, ids, hint, weights)
        if len(self.odd) and not odd.all():
            self._in_full(self.odd, np.flatnonzero(~odd), x, ids, hint, weights)
        rows = np.flatnonzero(~odd)
        if not len(rows) or not len(self.plain):
            return
        right = coarse[rows]
        size = np.square(right).sum(1)
        if self.metric == "euclidean":
            right = np.concatenate([right, size[:, None]], axis=1)
        right, most = np.ascontiguousarray(right.T.astype(np.float32)), float(size.max())
        own, edge = self.size[self.plain], self.edge[self.plain]
        # what the product may be off by, on either side of the exact score
        if self.metric == "euclidean":
            limit = edge if self.raw else np.square(np.maximum(edge, 0))
            slack = 4 * (x.shape[1] + 8) * _UNIT * (own + 2 * most) + 1e-12 * np.where(np.isfinite(limit), limit, 0) + 1e-30
            least = own - limit - slack
        else:
            least = {True: -edge, False: 1.0 - edge if self.metric == "cosine" else -edge}[self.raw]
            slack = 4 * (x.shape[1] + 8) * _UNIT * (np.sqrt(own * most) + 1e-6) + 1e-12 * np.where(np.isfinite(edge), np.abs(edge), 0)
            least = least - slack
        if self.sure is not None:  # from here on the product alone tells that a pair is in range
            limit = np.where(edge >= 0, least + 2 * slack, np.inf) if self.metric == "euclidean" else least + 2 * slack
            certain = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        first = not self.distinct and self.seen == 0 and len(rows) > self.k
        for i in range(0, len(self.plain), QUERIES):
            left, bound = self.left[i : i + QUERIES], least[i : i + QUERIES]
            for a in range(0, len(rows), ROWS):
                near = left @ right[:, a : a + ROWS]
                if first:  # FIRST rows, one product: the k-th of them bounds the others
                    kth = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k].astype(float)
                    bound = np.maximum(bound, kth - 2 * slack[i : i + QUERIES])
                low = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
                hits = near >= low[:, None]
                if self.sure is not None:
                    inside = near >= certain[i : i + QUERIES, None]
                    self.sure[self.plain[i : i + QUERIES]] += np.count_nonzero(inside, axis=1)
                    hits &= ~inside
                hit = np.flatnonzero(hits.ravel())
                if len(hit):
                    q, r = np.divmod(hit, near.shape[1])
                    q, r = self.plain[i + q], rows[a + r]
                    self._offer(q, ids[r], self._exact(q, x, r, known, weights))

    def matches(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries and of rows, and distances, of all pairs ``within`` the bound, some rows at a time; nothing is kept."""
        from vectide.operators.search import _norms

        self.seen = 1  # no k-th row bounds the pairs
        step = max(1, PAIRS // max(1, len(self.q)))
        for i in range(0, len(x), step):
            with np.errstate(all="ignore"):
                self._step(x[i : i + step], np.arange(i, min(len(x), i + step)), _norms(x[i : i + step]), None, None)
            if self.fresh:
                q, at, key = (np.concatenate(c) for c in zip(*self.fresh))
                self.fresh, self.waiting = [], 0
                yield q, at, -key if self.raw and not self.up else key

    def tally(self, x: np.ndarray) -> np.ndarray:
        """How many rows each query has ``within`` the bound: only pairs that the product leaves open get exact scores."""
        from vectide.operators.search import _norms

        self.seen, self.sure = 1, np.zeros(len(self.q), np.int64)  # no k-th row bounds the pairs
        for i in range(0, len(x), ROWS):
            with np.errstate(all="ignore"):
                self._step(x[i : i + ROWS], np.arange(i, min(len(x), i + ROWS)), _norms(x[i : i + ROWS]), None, None)
        counts, self.sure = self.sure, None
        return counts

    def _in_full(self, q_at, rows, x, ids, hint, weights) -> None:
        step = max(1, 250_000 // len(rows))
        for i in range(0, len(q_at), step):
            q = q_at[i : i + step]
            key = self._dense(q, x[rows], None if hint is None else hint[rows], None if weights is None else weights[rows])
            a, b = np.nonzero(key <= self.edge[q][:, None])  # never what is no number
            if len(a):
                self._offer(q[a], ids[rows[b]], key[a, b])
            if self.waiting > PAIRS and not self.seen:
                self._settle(True)

    def _offer(self, q, ids, key) -> None:
        keep = key <= self.edge[q]
        if self.sure is not None:
            self.sure += np.bincount(q[keep], minlength=len(self.q))
        elif keep.any():
            self.fresh.append((q[keep], ids[keep], key[keep]))
            self.waiting += int(keep.sum())

    def _settle(self, now: bool) -> None:
        """Keep k rows a query of those offered."""
        if not now or not self.fresh:
            return
        at, names, key = (np.concatenate(c) for c in zip((self.at, self.id, self.key), *self.fresh))
        self.fresh, self.waiting = [], 0
        if self.distinct:
            o = np.lexsort((key, names, at))
            at, names, key = at[o], names[o], key[o]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (names[1:] != names[:-1])
            at, names, key = at[new], names[new], key[new]
        o = np.lexsort((names, key, at))
        at, names, key = at[o], names[o], key[o]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        last = place == self.k - 1
        self.edge[at[last]] = np.minimum(self.edge[at[last]], key[last])
        keep = place < self.k
        self.at, self.id, self.key, self.place = at[keep], names[keep], key[keep], place[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, ids, and distances (or raw scores), by query, the nearest first, ties by id."""
        self._settle(True)
        return self.at, self.id, -self.key if self.raw and not self.up else self.key


def one_nearest(x: np.ndarray, model: np.ndarray, metric: str = "euclidean", raw: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the nearest of ``model``, the lowest of equals, and its distance; -1 and infinity where none is a number."""
    at, best = np.full(len(x), -1), np.full(len(x), np.inf)
    search = Nearest(x, 1, metric, raw)
    search.add(model, np.arange(len(model)))
    q, i, d = search.found()
    at[q], best[q] = i, d
    return at, best
