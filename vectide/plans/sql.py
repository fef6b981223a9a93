"""Pieces of DuckDB SQL that give the same numbers, bit by bit, as the Spark expressions."""

from __future__ import annotations

D = 64
#: Vectors scaled by their label, so that the metrics rank them differently.
SCALED = f"emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS v, label FROM embeddings)"
PLAIN = "emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
CENTROIDS = "cen AS (SELECT id // 20 AS list_id, v AS c FROM emb WHERE id % 20 = 0)"


def fold(term: str, d: int = D) -> str:
    """The sum of a term in ``i`` from 1 to d, from the first on."""
    return f"list_sum(list_transform(range(1, {d + 1}), lambda i: {term}))"


def l2sq(a: str, b: str, d: int = D) -> str:
    return fold(f"({a}[i] - {b}[i]) * ({a}[i] - {b}[i])", d)


def dot(a: str, b: str, d: int = D) -> str:
    return fold(f"{a}[i] * {b}[i]", d)


def similarity(a: str, b: str) -> str:
    below = f"sqrt({dot(a, a)} * {dot(b, b)})"
    return f"(CASE WHEN {below} > 1.1920929e-7 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot(a, b)} / {below})) ELSE 0.0 END)"


def distance(metric: str, a: str, b: str) -> str:
    return {
        "euclidean": f"sqrt({l2sq(a, b)})",
        "cosine": f"(1.0::DOUBLE - {similarity(a, b)})",
        "dot": f"(-{dot(a, b)})",
        "manhattan": fold(f"abs({a}[i] - {b}[i])"),
        "chebyshev": f"list_max(list_transform(range(1, {D + 1}), lambda i: abs({a}[i] - {b}[i])))",
    }[metric]


def score(metric: str, a: str, b: str) -> str:
    return {"euclidean": l2sq(a, b), "dot": dot(a, b), "cosine": similarity(a, b)}[metric]


def ranked(source: str, order: str, by: str = "qid") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source})"
