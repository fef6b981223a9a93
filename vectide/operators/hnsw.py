"""Navigable small-world graphs, one for each shard of a collection.

A shard is the rows that a hash of the id deals to it; a task builds its graph, and a search asks
every shard and merges the answers.  The graph of a shard is one row: arrays of ids, levels,
vectors, edges and tombstones.  Shards have ``rows_per_shard`` rows until there are ``MOST_SHARDS``;
then they grow, so that a query asks no more of them, up to ``SHARD_BYTES``, so that a task holds a
bounded graph (``shards_for``).  Rows alone decide, not the cluster.  Shards that have outgrown
``rows_per_shard`` are searched wider, up to ``WIDEST`` times.  ``sources.graphs`` stores graphs and
updates them.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.operators import kmeans
from vectide.operators.search import dimension_of, found_schema, matrix, query_blocks
from vectide.operators.telemetry import Telemetry
from vectide.operators.topk import top_k_by
from vectide.schema import Collection, VectorError, check_k
from vectide.sources.store import stored

MAX_LEVEL = 16
#: Of a list that is too large for one graph, the parts that a row of a neighbour graph asks.
PARTS_ASKED = 4
#: Shards that more rows don't make more, and the bytes of vectors that a shard of these has at most.
MOST_SHARDS, SHARD_BYTES = 24, 32 << 20
#: How many times wider than ``ef_search`` a shard that outgrew ``rows_per_shard`` is searched, at most.
WIDEST = 4
#: Nodes that a step of a walk expands for each query.
_STEP = 8
GRAPHS = "shard int, ids array<{id}>, levels array<int>, vectors array<float>, sources array<int>, edge_levels array<int>, targets array<int>, dead array<int>"


@dataclass(frozen=True)
class Settings:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42


def draw_level(m: int, rng: np.random.Generator, cap: int = MAX_LEVEL) -> int:
    u = min(max(rng.random(), 1e-9), 1 - 1e-9)
    return min(int(-math.log(u) / math.log(max(m, 2))), cap)


def _near(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances that order neighbours: squared for Euclidean; zero vectors are 1 away by cosine."""
    if metric == "euclidean":
        d = x - q
        return np.einsum("nd,nd->n", d, d)
    if metric == "dot":
        return -(x @ q)
    below = np.sqrt((x * x).sum(1) * (q @ q))
    return 1.0 - np.where(below > 1.1920929e-7, np.clip((x @ q) / np.where(below > 0, below, 1), -1, 1), 0.0)


def _near_each(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """``_near`` along the last axis of two arrays that broadcast."""
    if metric == "euclidean":
        d = x - q
        return np.einsum("...d,...d->...", d, d)
    products = np.einsum("...d,...d->...", x, q)
    if metric == "dot":
        return -products
    below = np.sqrt(np.einsum("...d,...d->...", x, x) * np.einsum("...d,...d->...", q, q))
    return 1.0 - np.where(below > 1.1920929e-7, np.clip(products / np.where(below > 0, below, 1), -1, 1), 0.0)


def choose_neighbors(q: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, m: int, metric: str = "euclidean") -> list[int]:
    """At most m of the nodes: from the nearest 2 m on those that are nearer to q than to any chosen one, then the nearest rest; ties by node."""
    nodes = np.unique(nodes)
    d = _near(q, vectors[nodes], metric)
    ranked = np.lexsort((nodes, d))[: 2 * m]
    nodes, d = nodes[ranked], d[ranked]
    if not len(nodes):
        return []
    closer = _between(vectors[nodes], metric) < d[:, None]  # closer[i, j]: node j is nearer to node i than q is
    free, chosen, rest = np.ones(len(nodes), bool), [], []
    for i in range(len(nodes)):
        if len(chosen) == m:
            break
        if free[i]:
            chosen.append(i)
            free &= ~closer[:, i]
        else:
            rest.append(i)
    return nodes[chosen + rest[: m - len(chosen)]].tolist()


def drop_one_each(q: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, metric: str = "euclidean", dead: np.ndarray | None = None) -> np.ndarray:
    """``choose_neighbors`` of all but one, for many q at once: a row of distinct nodes for each.

    Of equally near nodes those of ``dead`` come last, so that a row put back isn't hidden by its own tombstone.
    """
    nodes = np.sort(nodes, axis=1)
    if dead is not None:
        nodes = np.take_along_axis(nodes, np.argsort(dead[nodes], axis=1, kind="stable"), 1)
    d = _near_each(q[:, None], vectors[nodes], metric)
    ranked = np.argsort(d, axis=1, kind="stable")
    nodes, d = np.take_along_axis(nodes, ranked, 1), np.take_along_axis(d, ranked, 1)
    closer = _between(vectors[nodes], metric) < d[:, :, None]
    free, chosen = np.ones(nodes.shape, bool), np.zeros(nodes.shape, bool)
    for i in range(nodes.shape[1]):
        chosen[:, i] = free[:, i]
        free &= ~(closer[:, :, i] & free[:, i : i + 1])
    order = np.argsort(~chosen, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1)[:, :-1]


def _between(x: np.ndarray, metric: str) -> np.ndarray:
    """``_near`` of all pairs of a few rows, or of the rows of each of several groups."""
    products = x @ np.swapaxes(x, -1, -2)
    squares = np.diagonal(products, axis1=-2, axis2=-1)
    if metric == "euclidean":
        return np.maximum(0.0, squares[..., :, None] + squares[..., None, :] - 2 * products)
    if metric == "dot":
        return -products
    below = np.sqrt(squares[..., :, None] * squares[..., None, :])
    return 1.0 - np.where(below > 1.1920929e-7, np.clip(products / np.where(below > 0, below, 1), -1, 1), 0.0)


def prune_neighbors(q: np.ndarray, node: int, nodes: np.ndarray, vectors: np.ndarray, m: int, metric: str = "euclidean") -> list[int]:
    """The m nearest distinct nodes but for the node itself."""
    nodes = np.unique(nodes[nodes != node])
    return nodes[np.lexsort((nodes, _near(q, vectors[nodes], metric)))[:m]].tolist()


class Graph:
    """A graph over the rows of one shard, in order of their ids."""

    def __init__(self, vectors: np.ndarray, metric: str, s: Settings):
        self.x, self.metric, self.s = np.asarray(vectors, float), metric, s
        self.levels: list[int] = []
        self.edges: list[list[list[int]]] = []
        self.entry = -1
        self.dead = np.zeros(len(self.x), bool)
        self.visited = 0

    def grow(self, vectors: np.ndarray) -> None:
        """Rows that ``add`` will link in."""
        self.x = np.concatenate([self.x.reshape(-1, vectors.shape[1]), np.asarray(vectors, float)])
        self.dead = np.concatenate([self.dead, np.zeros(len(vectors), bool)])

    def descend(self, q: np.ndarray, start: int, top: int, bottom: int) -> int:
        """The nearest node that greedy steps reach from ``start`` in the levels above ``bottom``."""
        best, d = start, float(_near(q, self.x[[start]], self.metric)[0])
        for level in range(top, bottom, -1):
            moved = True
            while moved:
                moved, around = False, self.edges[best][level]
                if around:
                    self.visited += len(around)
                    ds = _near(q, self.x[around], self.metric)
                    i = int(ds.argmin())
                    if ds[i] < d:
                        best, d, moved = around[i], float(ds[i]), True
        return best

    def explore(self, q: np.ndarray, starts: list[int], ef: int, level: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The best ``ef`` (distance, node) that a best-first search of a level finds; barred nodes are passed through."""
        seen = set(starts)
        ds = _near(q, self.x[starts], self.metric)
        todo = [(float(d), n) for d, n in zip(ds, starts)]
        heapq.heapify(todo)
        found = [(-d, -n) for d, n in todo if allowed is None or allowed[n]]
        heapq.heapify(found)
        while todo:
            d, node = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            around = [n for n in self.edges[node][level] if n not in seen]
            if not around:
                continue
            seen.update(around)
            self.visited += len(around)
            for dn, n in zip(_near(q, self.x[around], self.metric).tolist(), around):
                if len(found) < ef or (-dn, -n) > found[0]:
                    heapq.heappush(todo, (dn, n))
                    if allowed is None or allowed[n]:
                        heapq.heappush(found, (-dn, -n))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def add(self, level: int, near: list[np.ndarray] | None = None) -> None:
        """Link the next row in.  ``near`` are its nearest earlier nodes of each level; without them the graph is searched."""
        node, q = len(self.levels), self.x[len(self.levels)]
        self.levels.append(level)
        self.edges.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        top, alive = self.levels[self.entry], ~self.dead if self.dead.any() else None
        starts = [] if near is not None else [self.descend(q, self.entry, top, level)]
        for at in range(min(level, top), -1, -1):
            if near is None:
                found = np.array([n for _, n in self.explore(q, starts, max(self.s.ef_construction, self.s.m), at, alive)], int)
                starts = found.tolist() or starts
            else:
                found = near[at]
            chosen = self.choose(q, found)
            self.edges[node][at] = chosen
            full = []
            for n in chosen:
                around = self.edges[n][at]
                around.append(node)
                if len(around) > self.s.m:
                    full.append(n)
            if full:
                kept = drop_one_each(self.x[full], np.array([self.edges[n][at] for n in full]), self.x, self.metric, None if alive is None else self.dead)
                for n, around in zip(full, kept.tolist()):
                    self.edges[n][at] = around
        if level > top:
            self.entry = node

    def choose(self, q: np.ndarray, nodes: np.ndarray) -> list[int]:
        return choose_neighbors(q, nodes, self.x, self.s.m, self.metric)

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        if self.entry < 0 or k < 1:
            return []
        start = self.descend(q, self.entry, self.levels[self.entry], 0)
        found = self.explore(q, [start], max(ef, k), 0, allowed)[:k]
        return [(math.sqrt(d), n) for d, n in found] if self.metric == "euclidean" else found


    def ways(self, level: int) -> np.ndarray:
        """The neighbours of each node in a level, filled up with the number of nodes."""
        n = len(self.levels)
        out = np.full((n + 1, self.s.m), n, np.int32)
        for i, levels in enumerate(self.edges):
            if level < len(levels):
                out[i, : len(levels[level])] = levels[level]
        return out

    def search_all(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None):
        """``search`` of many queries in step: yields places of the queries, nodes and distances."""
        n = len(self.levels)
        if self.entry < 0 or k < 1:
            return
        if allowed is not None and 2 * allowed.sum() < n:  # most nodes are only passed through: one query after another
            for i, v in enumerate(q):
                if found := self.search(v, k, ef, allowed):
                    d, nodes = zip(*found)
                    yield np.full(len(d), i), np.array(nodes), np.array(d)
            return
        ways = [self.ways(level) for level in range(self.levels[self.entry] + 1)]
        at_once = max(64, _WALK_CELLS // max(n, 1 << 13))
        for a in range(0, len(q), at_once):
            part = q[a : a + at_once]
            starts = np.full(len(part), self.entry)
            for level in range(len(ways) - 1, 0, -1):
                starts = self._walk(part, starts, 1, ways[level])[1][:, 0]
            d, nodes = self._walk(part, starts, max(ef, k), ways[0], allowed)
            order = np.lexsort((nodes, d), axis=1)[:, :k]
            d, nodes = np.take_along_axis(d, order, 1), np.take_along_axis(nodes, order, 1)
            rows, cols = np.nonzero(np.isfinite(d))
            yield a + rows, nodes[rows, cols], np.sqrt(d[rows, cols]) if self.metric == "euclidean" else d[rows, cols]

    def _walk(self, q: np.ndarray, starts: np.ndarray, ef: int, ways: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``explore`` of many queries in step: for each the distances and nodes of the best ``ef``, unsorted; where there are fewer, infinity."""
        n, rows = len(self.levels), np.arange(len(q))
        step = min(_STEP, ef)
        ok = None if allowed is None else np.append(allowed, False)
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n], seen[rows, starts] = True, True
        d, nodes, done = np.full((len(q), ef), np.inf), np.full((len(q), ef), n), np.ones((len(q), ef), bool)
        d[:, 0], nodes[:, 0], done[:, 0] = _near_each(q, self.x[starts], self.metric), starts, False
        out = [(np.full(ef, np.inf), np.full(ef, n))] * len(q)
        while len(rows):
            left = np.where(done, np.inf, d)
            at = np.argpartition(left, step - 1, axis=1)[:, :step] if step > 1 else left.argmin(1)[:, None]
            go = np.isfinite(np.take_along_axis(left, at, 1))
            walking = go.any(1)
            if 4 * walking.sum() <= 3 * len(rows):
                for i in np.flatnonzero(~walking).tolist():
                    out[rows[i]] = d[i], nodes[i]
                rows, d, nodes, done, at, go = rows[walking], d[walking], nodes[walking], done[walking], at[walking], go[walking]
                if not len(rows):
                    break
            expanded = np.take_along_axis(nodes, at, 1)
            np.put_along_axis(done, at, True, 1)
            around = ways[np.where(go, expanded, n)].reshape(len(rows), -1)
            if step > 1:  # two of the expanded may lead to one node
                around.sort(axis=1)
                around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            new = ~seen[rows[:, None], around]
            seen[rows[:, None], around] = True
            r, c = np.nonzero(new)
            self.visited += len(r)
            more = np.full(around.shape, np.inf)
            more[r, c] = _near_each(q[rows[r]], self.x[around[r, c]], self.metric)
            d, nodes, done = np.hstack([d, more]), np.hstack([nodes, around]), np.hstack([done, ~new])
            width = ef
            if ok is not None:  # barred nodes stay where they are nearer than the last of the best
                last = np.partition(np.where(ok[nodes], d, np.inf), ef - 1, axis=1)[:, ef - 1 : ef]
                d[d > last] = np.inf
                width = max(ef, int(np.isfinite(d).sum(1).max()))
            if width < d.shape[1]:
                best = np.argpartition(d, width - 1, axis=1)[:, :width]
                d, nodes, done = np.take_along_axis(d, best, 1), np.take_along_axis(nodes, best, 1), np.take_along_axis(done, best, 1)
        width = max(len(a) for a, _ in out)
        best, found = np.full((len(q), width), np.inf), np.full((len(q), width), n)
        for i, (a, b) in enumerate(out):
            best[i, : len(a)], found[i, : len(b)] = a, b
        return best if ok is None else np.where(ok[found], best, np.inf), found


#: Rows whose nearest earlier rows are found at once, and the distances that they have at most.
_AT_ONCE, _CELLS = 512, 1 << 22
#: Marks of seen nodes that a walk of more than 64 queries keeps; more run no faster.
_WALK_CELLS = 1 << 20


class Earlier:
    """The nearest earlier nodes of rows that are linked in one after another, by blocks of matrix products."""

    def __init__(self, g: Graph, levels: np.ndarray):
        self.g, self.levels = g, levels
        self.squares = np.einsum("nd,nd->n", g.x, g.x)
        self.a = self.b = 0

    def near(self, i: int, alive: bool) -> list[np.ndarray]:
        """Of each of a row's levels the ``ef_construction`` nearest nodes before it, ties by node; with ``alive`` no tombstones."""
        g = self.g
        most = max(g.s.ef_construction, g.s.m)
        if not self.a <= i < self.b:
            self._products(i)
        row, out = self.d[i - self.a, :i], []
        for level in range(self.levels[i] + 1):
            fit = (self.levels[:i] >= level) if level else None
            if alive:
                fit = ~g.dead[:i] if fit is None else fit & ~g.dead[:i]
            nodes = np.arange(i) if fit is None else np.flatnonzero(fit)
            if len(nodes) > most:
                d = row if fit is None else row[nodes]
                last = np.partition(d, most - 1)[most - 1]
                few = np.flatnonzero(d <= last + 1e-9 * (1 + abs(last)))  # a product's last bits depend on its block
                nodes = nodes[few]
                if len(nodes) > most:
                    nodes = nodes[np.lexsort((nodes, _near(g.x[i], g.x[nodes], g.metric)))[:most]]
            out.append(nodes)
        return out

    def _products(self, a: int) -> None:
        x = self.g.x
        self.a, self.b = a, min(len(x), a + max(1, min(_AT_ONCE, _CELLS // len(x))))
        self.d = x[self.a : self.b] @ x[: self.b].T
        if self.g.metric == "euclidean":
            self.d *= -2
            self.d += self.squares[None, : self.b]
        elif self.g.metric == "dot":
            np.negative(self.d, out=self.d)
        else:
            self.d /= -np.sqrt(np.maximum(self.squares[None, : self.b], 1e-30))


def build_graph(vectors: np.ndarray, metric: str = "euclidean", s: Settings = Settings(), drawn: np.ndarray | None = None) -> Graph:
    """A graph whose rows are linked to their nearest earlier rows, found exactly by blocks of matrix products.

    For the rows of a shard that is faster than to walk the graph, and no worse a choice: the
    ``ef_construction`` nearest are the best that a walk can find.
    """
    g, rng = Graph(vectors, metric, s), np.random.default_rng(s.seed)
    levels = np.array([draw_level(s.m, rng) for _ in range(len(g.x))], int) if drawn is None else drawn
    earlier = Earlier(g, levels)
    for i in range(len(g.x)):
        g.add(int(levels[i]), earlier.near(i, False))
    return g


def shards_for(n: int, rows_per_shard: int, d: int) -> int:
    """How many shards n rows of d numbers make: as many as ``rows_per_shard`` asks up to ``MOST_SHARDS``, beyond that as few as ``SHARD_BYTES`` allow."""
    largest = max(1, SHARD_BYTES // (8 * d))
    return max(1, min(-(-n // rows_per_shard), max(MOST_SHARDS, -(-n // largest))))


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with each shard in one partition, few with two: partitions of bytes would put the work of many in one task."""
    return rows.repartition(max(shards, min(8 * shards, 256)), "shard")


def build(collection: DataFrame, metric: str = "euclidean", settings: Settings = Settings(), rows_per_shard: int = 20_000) -> DataFrame:
    """The graphs of a collection: one row for each shard, of which there are as many as the rows ask."""
    d = dimension_of(collection)
    Collection(d, metric, "hnsw")
    shards = shards_for(collection.count(), rows_per_shard, d)
    dealt = collection.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    return build_shards(by_shard(dealt, shards), metric, settings)


def build_shards(dealt: DataFrame, metric: str, settings: Settings) -> DataFrame:
    """Graphs of ``dealt(shard, id, vector)``, with ``level`` if levels are drawn already."""
    schema = T.StructType.fromDDL(GRAPHS.format(id=dealt.schema["id"].dataType.simpleString()))
    d = dimension_of(dealt)

    def one(key, table):
        import pyarrow as pa

        table = table.sort_by("id").combine_chunks()
        x = matrix(table.column("vector").combine_chunks(), d).astype(np.float32)
        levels = table.column("level").to_numpy() if "level" in table.column_names else None
        return pa.Table.from_batches([packed(key[0].as_py(), table.column("id").combine_chunks(), build_graph(x, metric, settings, levels), schema)])

    return dealt.groupBy("shard").applyInArrow(one, schema)


def packed(shard: int, ids, g: Graph, schema: T.StructType):
    """A graph as a record batch of one row; ``ids`` is an Arrow array."""
    import pyarrow as pa

    kinds = to_arrow_schema(schema)
    lengths = np.array([[len(ns), i, level] for i, levels in enumerate(g.edges) for level, ns in enumerate(levels)], np.int32).reshape(-1, 3)
    targets = np.fromiter((n for levels in g.edges for ns in levels for n in ns), np.int32)
    columns = [ids, g.levels, g.x.astype(np.float32).ravel(), np.repeat(lengths[:, 1], lengths[:, 0]), np.repeat(lengths[:, 2], lengths[:, 0]), targets, np.flatnonzero(g.dead)]
    out = [pa.array([shard], pa.int32())]
    for values, kind in zip(columns, list(kinds)[1:]):
        values = values.cast(kind.type.value_type) if isinstance(values, pa.Array) else pa.array(values, kind.type.value_type)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, kind.type))
    return pa.RecordBatch.from_arrays(out, schema=kinds)


def load(batch, i: int, metric: str, settings: Settings) -> tuple:
    """The ids (an Arrow array) and the graph of one row of a batch, by Arrow's buffers."""
    row = {name: batch.column(name)[i].values for name in ("ids", "levels", "vectors", "sources", "edge_levels", "targets", "dead")}
    flat = {name: row[name].to_numpy(zero_copy_only=False) for name in ("levels", "vectors", "sources", "edge_levels", "targets", "dead")}
    n = len(row["ids"])
    g = Graph(flat["vectors"].reshape(n, -1) if n else np.zeros((0, 1)), metric, settings)
    g.levels = flat["levels"].tolist()
    g.edges = [[[] for _ in range(level + 1)] for level in g.levels]
    if len(flat["targets"]):
        change = np.flatnonzero(np.diff(flat["sources"]) | np.diff(flat["edge_levels"])) + 1
        starts = np.concatenate([[0], change])
        for a, level, part in zip(flat["sources"][starts].tolist(), flat["edge_levels"][starts].tolist(), np.split(flat["targets"], change)):
            g.edges[a][level] = part.tolist()
    g.entry = int(np.argmax(g.levels)) if n else -1
    g.dead[flat["dead"]] = True
    return row["ids"], g


def without_tombstones(ids, g: Graph) -> tuple:
    """The live ids and a graph of them: who led to a dropped node is linked to what that led to, and every node stays reachable."""
    alive = np.flatnonzero(~g.dead)
    place = np.full(len(g.dead), -1)
    place[alive] = np.arange(len(alive))
    new = Graph(g.x[alive], g.metric, g.s)
    new.levels = [g.levels[n] for n in alive]
    new.edges = [[[] for _ in range(level + 1)] for level in new.levels]
    for node in alive.tolist():
        for level, around in enumerate(g.edges[node]):
            found, todo, seen = set(), [n for n in around if g.dead[n]], set()
            while todo:  # through dropped nodes to live ones
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    beyond = g.edges[n][level] if level < len(g.edges[n]) else []
                    found.update(m for m in beyond if not g.dead[m])
                    todo += [m for m in beyond if g.dead[m]]
            kept = [n for n in around if not g.dead[n]]
            found = (found | set(kept)) - {node}
            kept = kept if not seen else g.choose(g.x[node], np.array(sorted(found), int)) if found else []
            new.edges[place[node]][level] = [int(place[n]) for n in kept]
    if len(alive):
        new.entry = int(np.argmax(new.levels))
        _reach(new)
    return ids.take(alive), new


def _reach(g: Graph) -> None:
    """Link in what the entry doesn't lead to on the lowest level, one node after another, from its nearest reachable node."""
    n = len(g.levels)
    reached, todo = np.zeros(n, bool), [g.entry]
    reached[g.entry] = True
    rest = None
    while True:
        while todo:
            around = [m for m in g.edges[todo.pop()][0] if not reached[m]]
            reached[around] = True
            todo += around
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return
        lost, inside = int(rest[0]), np.flatnonzero(reached)
        near = inside[np.argsort(_near(g.x[lost], g.x[inside], g.metric), kind="stable")]
        host = next((int(m) for m in near[:64] if len(g.edges[m][0]) < g.s.m), None)
        if host is None:  # all are full: one leads here instead of to its farthest, which leads back to it
            host = int(near[0])
            far = max(g.edges[host][0], key=lambda m: float(_near(g.x[host], g.x[[m]], g.metric)[0]))
            g.edges[host][0].remove(far)
            g.edges[lost][0] = [far, *[m for m in g.edges[lost][0] if m != far]][: g.s.m]
            reached[:] = False
            reached[g.entry], todo = True, [g.entry]
        g.edges[host][0].append(lost)
        if len(g.edges[lost][0]) < g.s.m and host not in g.edges[lost][0]:
            g.edges[lost][0].append(host)
        if reached[host]:
            todo.append(host)


def wider(ef: int, rows: int, rows_per_shard: int | None) -> int:
    return ef if not rows_per_shard else int(ef * min(max(1.0, rows / rows_per_shard), WIDEST))


def search(graphs: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", settings: Settings = Settings(), allowed: DataFrame | None = None, filter_mode: str = "pre", telemetry: Telemetry | None = None, rows_per_shard: int | None = None) -> DataFrame:
    """``(qid, rank, id, distance)``.

    ``allowed(id)`` are the ids that may be found: by default the traversal only keeps those, with
    ``filter_mode="post"`` results are filtered at the end, and fewer may be left.  A shard of more
    than ``rows_per_shard`` rows is searched wider, in proportion, up to ``WIDEST`` times.
    """
    k = check_k(k, "hnsw.search")
    d = dimension_of(queries, "q")
    schema = found_schema(queries.schema["qid"].dataType, graphs.schema["ids"].dataType.elementType)
    count = telemetry.counters() if telemetry else None
    if allowed is not None and filter_mode == "pre":
        inside = graphs.select("shard", F.posexplode("ids").alias("at", "id")).join(allowed.select("id").distinct(), "id", "left_semi")
        graphs = graphs.join(inside.groupBy("shard").agg(F.collect_list("at").alias("allowed")), "shard", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<int>")))
    out = None
    for block in query_blocks(queries, d):
        table = block.select("qid", "q").toArrow()  # a bounded block
        data = table.column("qid").combine_chunks(), matrix(table.column("q").combine_chunks(), d)

        def run(batches, data=data):
            import pyarrow as pa

            kinds = to_arrow_schema(schema)
            qids, q = data
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, g = load(batch, i, metric, settings)
                    mask = ~g.dead
                    ef = wider(settings.ef_search, int(mask.sum()), rows_per_shard)
                    if "allowed" in batch.schema.names:
                        inside = np.zeros(len(ids), bool)
                        inside[batch.column("allowed")[i].values.to_numpy(zero_copy_only=False)] = True
                        mask &= inside
                    before = 0
                    for of, at, dists in g.search_all(q, k, ef, None if mask.all() else mask):
                        if count:
                            count["nodes_visited"].add(g.visited - before)
                            count["found"].add(len(at))
                            before = g.visited
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)).cast(kinds.field("qid").type), ids.take(pa.array(at)), pa.array(dists, pa.float64())], names=schema.names)

        hits = graphs.mapInArrow(run, schema)
        best = top_k_by(hits, k).select("qid", "rank", "id", "distance")
        out = best if out is None else out.unionByName(best)
    if allowed is not None and filter_mode == "post":
        out = out.join(allowed.select("id").distinct(), "id", "left_semi").select("qid", "rank", "id", "distance")
    return out


def knn_graph(collection: DataFrame, k: int = 15, metric: str = "euclidean", settings: Settings = Settings(), rows_per_shard: int = 20_000, probes: int = 4) -> DataFrame:
    """``(src, rank, dst, distance)``: approximate neighbours of all rows, Euclidean weights, none of itself.

    Rows are dealt to lists of near rows, of about ``rows_per_shard`` each, and each list becomes a
    graph.  A row asks the graphs of the ``probes`` lists nearest to it, so the work grows with the
    rows.  A list that is too large is cut into graphs by a hash; of these a row asks its own and
    the next, ``PARTS_ASKED`` in all.
    """
    if metric == "dot":
        raise VectorError("unsupported_metric", "a neighbour graph takes euclidean and cosine", "hnsw.knn_graph")
    n = collection.count()
    if n < 2 or not 1 <= k <= n - 1:
        raise VectorError("invalid_k", "k is from 1 to the number of rows less one", "hnsw.knn_graph", k=k, n=n)
    ef = max(settings.ef_search, 2 * k, k + 1)
    wide = Settings(settings.m, settings.ef_construction, ef, settings.seed)
    lists = -(-n // rows_per_shard)
    centroids = stored(kmeans.train(collection, lists, settings.seed), "centroids")
    dealt = stored(kmeans.assign_in_place(collection.select("id", "vector"), centroids, metric).drop("distance"), "dealt")
    sizes = {r.list_id: r["count"] for r in dealt.groupBy("list_id").count().collect()}  # a row for each list
    first, parts, at = {}, {}, 0
    for i in sorted(sizes):
        first[i], parts[i] = at, -(-sizes[i] // (2 * rows_per_shard))
        at += parts[i]
    places = collection.sparkSession.createDataFrame([(i, first[i], parts[i]) for i in sizes], "list_id int, _first int, _parts int")
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    shard = lambda step: (F.col("_first") + F.pmod(part + step, F.col("_parts"))).cast("int")
    graphs = build_shards(dealt.join(F.broadcast(places), "list_id").select("id", "vector", shard(F.lit(0)).alias("shard")), metric, settings)
    asking = _nearest_lists(dealt, centroids, min(probes, lists), metric).join(F.broadcast(places), "list_id")
    asking = asking.withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.col("_parts"), F.lit(PARTS_ASKED)) - 1)))
    asking = asking.select(shard(F.col("_step")).alias("shard"), F.col("id").alias("qid"), F.col("vector").alias("q"))
    found = _asked(graphs, asking, k + 1, metric, wide).where("qid <> id")
    best = top_k_by(found, k)
    weight = F.sqrt(F.greatest(F.lit(0.0), F.col("distance") * 2)) if metric == "cosine" else F.col("distance")
    return best.select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"), weight.alias("distance"))


def _nearest_lists(rows: DataFrame, centroids: DataFrame, n: int, metric: str) -> DataFrame:
    """``(id, vector, list_id)``: each row with each of its n nearest lists, found where the row stands."""
    from vectide.operators.search import distances

    model = sorted((r.list_id, r.centroid) for r in centroids.collect())  # a centroid for each ``rows_per_shard`` rows
    numbers, c = np.array([i for i, _ in model], np.int32), np.array([v for _, v in model], float)
    schema = T.StructType([rows.schema["id"], rows.schema["vector"], T.StructField("list_id", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            d = distances(c, matrix(batch.column(1), c.shape[1]), metric).T
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            each = pa.array(np.repeat(np.arange(len(d)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(numbers[near].ravel())], names=schema.names)

    return rows.select("id", "vector").mapInArrow(run, schema)


def _asked(graphs: DataFrame, asking: DataFrame, k: int, metric: str, settings: Settings) -> DataFrame:
    """``(qid, id, distance)``: k nearest in each shard of ``asking(shard, qid, q)``; a shard's graph and its queries meet in a task."""
    schema = found_schema(asking.schema["qid"].dataType, graphs.schema["ids"].dataType.elementType)

    def run(key, graph, queries):
        import pyarrow as pa

        kinds = to_arrow_schema(schema)
        if not graph.num_rows or not queries.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in kinds})
        ids, g = load(graph.combine_chunks().to_batches()[0], 0, metric, settings)
        q = matrix(queries.column("q").combine_chunks(), g.x.shape[1])
        mask = None if not g.dead.any() else ~g.dead
        found = list(zip(*g.search_all(q, k, settings.ef_search, mask)))
        at, where, dists = map(np.concatenate, found) if found else ((), (), ())
        return pa.table({"qid": queries.column("qid").take(pa.array(at, pa.int64())), "id": ids.take(pa.array(where, pa.int64())), "distance": pa.array(dists, pa.float64())}, schema=kinds)

    return graphs.groupBy("shard").cogroup(asking.groupBy("shard")).applyInArrow(run, schema)


def vectors(graphs: DataFrame) -> DataFrame:
    """``(id, vector)`` of the live rows."""
    d = (F.size("vectors") / F.size("ids")).cast("int")
    rows = graphs.where(F.size("ids") > 0).select("ids", "vectors", "dead", d.alias("_d"), F.posexplode("ids").alias("_at", "id"))
    return rows.where(~F.array_contains("dead", F.col("_at"))).select("id", F.slice("vectors", F.col("_at") * F.col("_d") + 1, F.col("_d")).alias("vector"))


def nodes(graphs: DataFrame) -> DataFrame:
    """``(shard, node, id, level, dead, entry)``: the entry is the first node of the top level, where each search begins."""
    rows = graphs.select("shard", "dead", (F.array_position("levels", F.array_max("levels")) - 1).alias("_entry"), F.posexplode(F.arrays_zip("ids", "levels")).alias("node", "n"))
    return rows.select("shard", "node", F.col("n.ids").alias("id"), F.col("n.levels").alias("level"), F.array_contains("dead", F.col("node")).alias("dead"), (F.col("node") == F.col("_entry")).alias("entry"))


def edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("shard", F.inline(F.arrays_zip(F.col("sources").alias("src"), F.col("edge_levels").alias("level"), F.col("targets").alias("dst"))))


def statistics(graphs: DataFrame) -> DataFrame:
    """One row: live rows, tombstones, the top level and the mean degree of the lowest level."""
    base = F.size(F.filter("edge_levels", lambda x: x == 0))
    return graphs.agg(F.sum(F.size("ids") - F.size("dead")).alias("count"), F.sum(F.size("dead")).alias("tombstones"), F.max(F.array_max("levels")).alias("max_level"), (F.sum(base) / F.sum(F.size("ids"))).alias("mean_degree"))
