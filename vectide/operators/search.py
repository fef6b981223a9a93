"""Exact search: nearest neighbours, ranges, re-ranking, neighbour graphs.

A search scores queries against a collection.  The queries are broadcast in blocks of at most
``QUERY_BYTES``, so a block always fits; more queries make more blocks, each a pass of its own.
``strategy="expr"`` scores by Spark expressions.  ``"arrow"`` scores Arrow batches by numpy, adds
dimension by dimension and so gives the same numbers bit by bit, and passes on only the rows that a
batch finds: k a query, or those in range.  ``"auto"`` takes Arrow where the queries' numbers are
many (``choose_strategy``).

Both strategies take odd vectors alike.  A null vector, or one of another dimension than the query,
is an error (``dimension_mismatch``).  A row whose distance is no number, because a component is null
or NaN, is not found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.functions import metrics
from vectide.functions.filters import id_pass
from vectide.operators.topk import top_k, top_k_by
from vectide.schema import METRICS, VectorError, check_k

if TYPE_CHECKING:
    from pyspark.sql import Observation

    from vectide.operators.readers import VectorReader
    from vectide.operators.telemetry import Telemetry

QUERY_BYTES = 32_000_000
#: Pairs that a worker scores at once, and numbers of the queries from which on Arrow batches pay.
PAIRS, MANY = 250_000, 512
#: Pairs whose sums are in the works at once.
TILE = 8192
#: Rows after which the ids of a result of all pairs come again, with the next query: files fold short cycles.
CYCLE = 256
#: Values of some queries with all columns that a task holds until their tiles are written.
HELD = 8_000_000


def dimension_of(df: DataFrame, column: str = "vector") -> int:
    first = df.select(F.size(column)).first()
    return first[0] if first else 1


def as_queries(spark, vectors, qids: Sequence | None = None) -> DataFrame:
    """``queries(qid, q)`` from one vector or several: lists, tuples, or arrays of any number type; ids count from 0 unless given."""
    import numpy as np

    x = np.asarray(vectors, float)
    x = x.reshape(1, -1) if x.ndim == 1 else x
    if x.ndim != 2 or not x.size:
        raise VectorError("empty_input", "no vectors", "as_queries", shape=x.shape)
    names = list(range(len(x))) if qids is None else list(qids)
    if len(names) != len(x):
        raise VectorError("invalid_parameter", "an id for each vector", "as_queries", ids=len(names), vectors=len(x))
    kind = "string" if isinstance(names[0], str) else "long"
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(names, x)], f"qid {kind}, q array<double>")


def query_blocks(queries: DataFrame, d: int, extra: int = 0) -> list[DataFrame]:
    """The queries in parts of which each may be broadcast: ``8 d + 64 + extra`` bytes a query."""
    n = queries.count()
    parts = max(1, -(-n * (8 * d + 64 + extra) // QUERY_BYTES))
    if parts == 1:
        return [queries]
    part = F.pmod(F.xxhash64("qid"), F.lit(parts))
    return [queries.where(part == p) for p in range(parts)]


def _check(metric: str, operation: str) -> None:
    if metric not in METRICS:
        raise VectorError("unsupported_metric", f"no metric {metric!r}", operation)


def sound(value: Column, vector: Column, d: int) -> Column:
    """``value``, or an error where the vector is null or of another dimension."""
    wrong = F.concat(F.lit("dimension_mismatch: a vector has another dimension, expected="), F.lit(d), F.lit(", found="), F.coalesce(F.size(vector), F.lit(-1)).cast("string"))
    return F.when(F.size(vector) == d, value).otherwise(F.raise_error(wrong).cast("double"))


def numbers(scored: DataFrame, column: str = "distance") -> DataFrame:
    """The rows whose distance is a number."""
    return scored.where(F.col(column).isNotNull() & ~F.isnan(column))


#: A norm hint that says that all vectors of a collection have norm 1.
NORMALIZED = "normalized"


def _hinted(norms: str | None, d: int) -> Column:
    """Squared norms of the rows: as hinted, and computed where there is no hint."""
    if norms == NORMALIZED:
        return F.lit(1.0)
    computed = metrics.norm_squared(F.col("vector"), d)
    if norms is None:
        return computed
    hint = F.col(norms).cast("double")
    return F.coalesce(F.when(~F.isnan(hint), hint), computed)


def pairs(collection: DataFrame, block: DataFrame, metric: str, d: int, raw: bool = False, norms: str | None = None) -> DataFrame:
    """``(qid, id, distance)`` of each row and each query of a block (broadcast: see ``query_blocks``)."""
    name = "score" if raw else "distance"
    queries = block.select("qid", F.col("q").alias("_q"))
    if metric == "cosine":  # norms once for each row and query, not for each pair
        rows = collection.select("id", "vector", _hinted(norms, d).alias("_x2"))
        queries = queries.withColumn("_q2", metrics.norm_squared(F.col("_q"), d))
        similarity = metrics.cosine_similarity(metrics.dot(F.col("_q"), F.col("vector"), d), F.col("_q2"), F.col("_x2"))
        return rows.join(F.broadcast(queries)).select("qid", "id", sound(similarity if raw else F.lit(1.0) - similarity, F.col("vector"), d).alias(name))
    how = metrics.score if raw else metrics.distance
    return collection.join(F.broadcast(queries)).select("qid", "id", sound(how(metric, F.col("_q"), F.col("vector"), d), F.col("vector"), d).alias(name))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn(collection: DataFrame, query: Sequence[float], k: int, metric: str = "euclidean", where: Column | None = None, norms: str | None = None) -> DataFrame:
    """``(rank, id, distance)`` of the k nearest rows to one vector; ``where`` filters before the search.

    ``query`` is any sequence or array of numbers; ``norms`` as in ``batch_knn``.
    """
    _check(metric, "knn")
    rows = collection if where is None else collection.where(where)
    d, v = len(query), F.col("vector")
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        value = F.lit(1.0) - metrics.cosine_similarity(metrics.dot(q, v, d), metrics.norm_squared(q, d), _hinted(norms, d))
    else:
        value = metrics.distance(metric, q, v, d)
    scored = rows.select("id", sound(value, v, d).alias("distance"))
    return top_k(numbers(scored), k).select("rank", "id", "distance")


def choose_strategy(n_queries: int, d: int) -> str:
    """``"arrow"`` where a row meets many numbers of the queries, else ``"expr"``."""
    return "arrow" if n_queries * d >= MANY else "expr"


def batch_knn(collection: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", where: Column | None = None, strategy: str = "auto", filter_mode: str = "pre", norms: str | None = None) -> DataFrame:
    """``(qid, rank, id, distance)`` for ``queries(qid, q)``.

    ``filter_mode="post"`` filters the k results instead, so that fewer may be left.

    ``norms`` is a hint for cosine distances, which is taken on trust: a column of the collection
    that holds squared norms (``transform.norms``), whose nulls and NaN are computed, or ``"normalized"``
    where all vectors have norm 1.  Other metrics need no norms and pass it over.
    """
    _check(metric, "batch_knn")
    k = check_k(k, "batch_knn")
    rows = collection.where(where) if where is not None and filter_mode == "pre" else collection
    d = dimension_of(queries, "q")
    found = []
    for block in query_blocks(queries, d):
        how = choose_strategy(block.count(), d) if strategy == "auto" else strategy
        scored = _arrow_nearest(rows, block, metric, k, norms) if how == "arrow" else numbers(pairs(rows, block, metric, d, norms=norms))
        found.append(top_k_by(scored, k).select("qid", "rank", "id", "distance"))
    out = _union(found)
    if where is not None and filter_mode == "post":
        out = out.join(collection.where(where).select("id"), "id", "left_semi").select("qid", "rank", "id", "distance")
    return out


def _sums(q, x, term):
    """Sums (queries, rows) of ``term`` of a dimension's numbers, from the first dimension on, as the expressions add."""
    import numpy as np

    out = np.zeros((len(q), len(x)))
    columns, wide = np.ascontiguousarray(x.T), max(1, min(len(x), 2048))
    tall = max(1, TILE // wide)
    for a in range(0, len(x), wide):
        for i in range(0, len(q), tall):
            tile = out[i : i + tall, a : a + wide]
            part = np.zeros(tile.shape)
            for j in range(q.shape[1]):
                part += term(q[i : i + tall, j, None], columns[None, j, a : a + wide])
            tile[:] = part
    return out


def _norms(x):
    """Squared norms, added from the first dimension on."""
    import numpy as np

    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += np.square(x[:, j])
    return out


def raw_scores(q, x, metric: str, x_squared=None):
    """What ``metrics.score`` gives, for all pairs of two double arrays: (queries, rows).

    ``x_squared`` holds squared norms of the rows, NaN where they are to be computed.
    """
    import numpy as np

    if metric == "euclidean":
        return _sums(q, x, lambda a, b: np.square(a - b))
    if metric == "dot":
        return _sums(q, x, np.multiply)
    if metric == "cosine":
        if x_squared is None:
            x_squared = _norms(x)
        elif (none := np.isnan(x_squared)).any():
            x_squared = x_squared.copy()
            x_squared[none] = _norms(x[none])
        below = np.sqrt(_norms(q)[:, None] * x_squared[None])
        product = _sums(q, x, np.multiply)
        similar = np.where(below > metrics.ULP, np.clip(product / np.where(below > metrics.ULP, below, 1.0), -1.0, 1.0), 0.0)
        return np.where(np.isnan(product), np.nan, similar)
    if metric == "manhattan":
        return _sums(q, x, lambda a, b: np.abs(a - b))
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        np.maximum(out, np.abs(q[:, j, None] - x[None, :, j]), out=out)
    return out


def distances(q, x, metric: str, x_squared=None):
    """What ``metrics.distance`` gives, for all pairs of two double arrays: (queries, rows)."""
    import numpy as np

    scores = raw_scores(q, x, metric, x_squared)
    return {"euclidean": lambda: np.sqrt(scores), "cosine": lambda: 1.0 - scores, "dot": lambda: -scores}.get(metric, lambda: scores)()


def matrix(column, d: int):
    """An Arrow list column as a double array (rows, d); a row that is null or of another length is an error."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if (lengths != d).any():
        raise VectorError("dimension_mismatch", "a vector has another dimension", "search", expected=d, found=int(lengths[lengths != d][0]))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def nearest_of(k: int):
    """From distances (queries, rows) the numbers up to each query's k-th, ties and all; the window picks by id."""

    def pick(d):
        import numpy as np

        if not k:
            return np.zeros((2, 0), int)
        if k >= d.shape[1]:
            return np.nonzero(~np.isnan(d))
        edge = np.partition(d, k - 1, axis=1)[:, k - 1, None]  # NaN comes last
        return np.nonzero((d <= edge) | (np.isnan(edge) & ~np.isnan(d)))

    return pick


def _arrow_scores(rows: DataFrame, block: DataFrame, metric: str, pick, raw: bool = False, norms: str | None = None) -> DataFrame:
    """``(qid, id, distance)`` of the pairs that ``pick`` finds in a batch's scores; ``norms`` is the hint of ``batch_knn``."""
    import numpy as np

    data = [(r.qid, r.q) for r in block.collect()]  # QUERY_BYTES at most
    queries = np.array([q for _, q in data], float).reshape(len(data), -1)
    qids = [qid for qid, _ in data]
    schema = found_schema(block.schema["qid"].dataType, rows.schema["id"].dataType)
    score = raw_scores if raw else distances
    hint = [] if norms is None or metric != "cosine" else [F.lit(1.0) if norms == NORMALIZED else F.col(norms).cast("double")]
    rows = rows.select("id", "vector", *[h.alias("_squared") for h in hint])

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_schema(schema).field("qid").type
        names = pa.array(qids, kind)
        for batch in batches:
            if not batch.num_rows or not qids:
                continue
            x = matrix(batch.column(1), queries.shape[1])
            squared = batch.column(2).to_numpy(zero_copy_only=False).astype(float) if batch.num_columns > 2 else None
            step = max(1, PAIRS // len(x))
            for i in range(0, len(qids), step):
                d = score(queries[i : i + step], x, metric, squared)
                q_at, at = pick(d)
                if len(q_at):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q_at + i)), batch.column(0).take(pa.array(at)), pa.array(d[q_at, at])], names=["qid", "id", "distance"])

    return rows.mapInArrow(run, schema)


def _arrow_range(rows: DataFrame, block: DataFrame, metric: str, threshold: float, telemetry: Telemetry | None = None, counts: bool = False) -> DataFrame:
    """``(qid, id, distance)`` of the pairs in range (``nearest.Nearest.matches``): Euclidean distances, raw scores of dot and cosine.

    With ``counts`` ``(qid, n)``, each task's numbers of such rows (``nearest.Nearest.tally``).

    Pairs whose norms alone are further apart than a Euclidean range count as skipped, the others as scored.
    """
    import numpy as np

    from vectide.operators.nearest import Nearest

    table = block.select("qid", "q").toArrow()  # QUERY_BYTES at most
    names, n = table.column(0).combine_chunks(), table.num_rows
    width = len(table.column(1)[0]) if n else 0
    queries = matrix(table.column(1).combine_chunks(), width) if n else np.empty((0, 0))
    raw, bound = metric in ("dot", "cosine"), threshold if metrics.ascending(metric) else -threshold
    schema = T.StructType([T.StructField("qid", block.schema["qid"].dataType), T.StructField("n", T.LongType())]) if counts else found_schema(block.schema["qid"].dataType, rows.schema["id"].dataType)
    q_norms, room = np.sqrt(np.square(queries).sum(1)), max(0.0, threshold) * (1 + 1e-9) + 1e-9
    count = telemetry.counters() if telemetry else None

    def run(batches):
        import pyarrow as pa

        search, within = Nearest(queries, 1, metric, raw, bound), np.zeros(n, np.int64)
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            x = matrix(batch.column(batch.num_columns - 1), width)
            if count:
                scored = n * len(x)
                if metric == "euclidean":
                    sizes = np.sort(np.sqrt(np.square(x).sum(1)))
                    lo, hi = np.searchsorted(sizes, q_norms - room, "left"), np.searchsorted(sizes, q_norms + room, "right")
                    scored = int(np.maximum(hi - lo, 0).sum())
                count["range_scored"].add(scored)
                count["range_skipped"].add(len(x) * n - scored)
            if counts:
                seen = search.tally(x)
                within += seen
                if count:
                    count["found"].add(int(seen.sum()))
                continue
            for q_at, at, d in search.matches(x):
                if count:
                    count["found"].add(len(q_at))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q_at)), batch.column(0).take(pa.array(at)), pa.array(d)], names=["qid", "id", "distance"])
        if counts:
            some = pa.array(np.flatnonzero(within))
            yield pa.RecordBatch.from_arrays([names.take(some), pa.array(within).take(some)], names=["qid", "n"])

    return spread(rows.select("vector") if counts else rows.select("id", "vector"), n).mapInArrow(run, schema)


def spread(rows: DataFrame, met: int) -> DataFrame:
    """The rows dealt to all cores, where each meets many others: a small table may be one file and so one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if met >= MANY else rows


def spread_alike(rows: DataFrame, met: int, key: str = "id", column: str = "vector") -> DataFrame:
    """``spread``, with the rows of equal vectors side by side, so that what they are given comes in runs; many copies of one go to several tasks."""
    if met < MANY:
        return rows
    dealt = rows.withColumn("_alike", F.xxhash64(column)).repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "_alike", key)
    return dealt.sortWithinPartitions("_alike").drop("_alike")


def runs(x, more=()):
    """Of rows (n, d), the places of those that are other than the one before, bit by bit, and for each row the number of its run."""
    import numpy as np

    bits = np.column_stack([x, *more]).astype(float).view(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (bits[1:] != bits[:-1]).any(1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def once(score: Callable, q, x):
    """``score(q, x)``, the values (queries, rows) of double arrays, with one score for copies that stand side by side."""
    (q_at, q_run), (x_at, x_run) = runs(q), runs(x)
    values = score(q[q_at], x[x_at])
    return values if values.shape == (len(q), len(x)) else values[q_run[:, None], x_run[None]]


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _arrow_nearest(rows: DataFrame, block: DataFrame, metric: str, k: int, norms: str | None = None, raw: bool = False, within: float = float("inf"), distinct: bool = False, weighted: bool = False) -> DataFrame:
    """``(qid, id, distance)``: each query's k nearest rows of a task (``nearest.Nearest``, whose arguments these are).

    ``weighted`` says that rows and queries have ``_x`` and ``_i``, factors of their inner products.
    Ids that are no integers are picked from each batch, ties and all.
    """
    import numpy as np

    if not _whole(rows.schema["id"].dataType):
        if weighted or within < float("inf"):
            raise VectorError("invalid_parameter", "ids are integers", "search")
        return _arrow_scores(rows, block, metric, nearest_of(k), raw, norms=norms)
    from vectide.operators.nearest import Nearest

    table = block.select("qid", "q", *(["_i"] if weighted else [])).toArrow()  # QUERY_BYTES at most
    names, n = table.column(0).combine_chunks(), table.num_rows
    width = len(table.column(1)[0]) if n else 0
    queries = matrix(table.column(1).combine_chunks(), width) if n else np.empty((0, 0))
    own = table.column(2).to_numpy().astype(float) if weighted else None
    schema = found_schema(block.schema["qid"].dataType, rows.schema["id"].dataType)
    kind = to_arrow_schema(schema).field("id").type
    hint = [F.col("_x")] if weighted else [] if norms is None or metric != "cosine" else [F.lit(1.0) if norms == NORMALIZED else F.col(norms).cast("double")]
    rows = spread(rows.select("id", "vector", *[h.alias("_more") for h in hint]), n)
    hinted = bool(hint)
    none = np.iinfo(np.int64).min  # a null id, which comes first as in Spark's order

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        search = Nearest(queries, k, metric, raw, within, distinct, own)
        for batch in batches:
            if batch.num_rows and n:
                more = batch.column(2).to_numpy(zero_copy_only=False).astype(float) if hinted else None
                ids = pc.fill_null(batch.column(0).cast(pa.int64()), none).to_numpy()
                search.add(matrix(batch.column(1), width), ids, None if weighted else more, more if weighted else None)
        at, ids, d = search.found()
        for i in range(0, len(at), PAIRS):
            part = slice(i, i + PAIRS)
            found = pa.array(ids[part], pa.int64(), mask=ids[part] == none).cast(kind)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[part])), found, pa.array(d[part])], names=["qid", "id", "distance"])

    return rows.mapInArrow(run, schema)


def all_pairs(rows: DataFrame, block: DataFrame, name: str, kind: T.DataType, score: Callable, nulls: bool = True) -> DataFrame:
    """``(qid, id, <name>)`` of each row and each query of a block, by Arrow batches.

    ``score(q, x, q_more, x_more)`` gives the values (queries, rows) of double arrays; what columns the
    rows and the block have beyond ``id, vector`` and ``qid, q`` come along.  A vector that is null, too
    short or has a null component gives nulls (without ``nulls``, what NaN gives); of a longer one the first numbers count.

    The result is the square of its input, so its order is one that files hold in few bytes: CYCLE rows
    with one query, then with the next, and copies of a vector, which are scored once, side by side.
    """
    import numpy as np

    more_q, more_x = [c for c in block.columns if c not in ("qid", "q")], [c for c in rows.columns if c not in ("id", "vector")]
    d = dimension_of(block, "q")
    table = block.select("qid", "q", *more_q).toArrow().combine_chunks()  # QUERY_BYTES at most
    q, q_known = loose_matrix(table.column(1).combine_chunks(), d) if table.num_rows else (np.empty((0, d)), np.empty(0, bool))
    order = np.lexsort(q.T) if d else np.arange(len(q))
    q, q_known = q[order], q_known[order]
    q_more = [table.column(i + 2).to_numpy().astype(float)[order] for i in range(len(more_q))]
    names = table.column(0).combine_chunks().take(order)
    first, run_of = runs(q, q_more)
    q, q_more = q[first], [m[first] for m in q_more]
    schema = T.StructType([block.schema["qid"], rows.schema["id"], T.StructField(name, kind)])
    rows = spread_alike(rows.select("id", "vector", *more_x), table.num_rows)

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not len(names):
                continue
            all_x, all_known = loose_matrix(batch.column(1), d)
            all_more = [batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(len(more_x))]
            for a in range(0, batch.num_rows, CYCLE):
                x, x_known, x_more = all_x[a : a + CYCLE], all_known[a : a + CYCLE], [m[a : a + CYCLE] for m in all_more]
                own, of = runs(x, x_more)
                ids, width = batch.column(0).slice(a, CYCLE), len(x)
                step = max(1, PAIRS // width)
                places = np.tile(np.arange(width), min(step, len(names)))
                for i in range(0, len(names), step):
                    part = slice(i, min(i + step, len(names)))
                    n, some = part.stop - i, slice(run_of[i], run_of[part.stop - 1] + 1)
                    with np.errstate(all="ignore"):
                        values = score(q[some], x[own], [m[some] for m in q_more], [m[own] for m in x_more])
                    if values.shape != (n, width):
                        values = values[(run_of[part] - some.start)[:, None], of[None]]
                    unknown = ~(q_known[part, None] & x_known[None]).ravel()
                    out = pa.array(values.ravel(), arrow.field(name).type, mask=unknown if nulls and unknown.any() else None)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(i, part.stop), width))), ids.take(pa.array(places[: n * width])), out], schema=arrow)

    return rows.mapInArrow(run, schema)


def tiles(values):
    """Of values (queries, columns) the places of both and the values, in the order of ``all_pairs``, about PAIRS at a time."""
    import numpy as np

    n, columns = values.shape
    wide = max(1, PAIRS // max(1, n * CYCLE)) * CYCLE
    for a in range(0, columns, wide):
        end = min(columns, a + wide)
        whole = a + (end - a) // CYCLE * CYCLE
        for low, high, width in ((a, whole, CYCLE), (whole, end, end - whole)):
            if high > low:
                shape = ((high - low) // width, n, width)
                at = np.broadcast_to(np.arange(low, high).reshape(-1, 1, width), shape)
                yield np.broadcast_to(np.arange(n)[None, :, None], shape).ravel(), at.ravel(), values[:, low:high].reshape(n, -1, width).transpose(1, 0, 2).flatten()


def loose_matrix(column, d: int):
    """An Arrow list column as a double array (rows, d), and which rows have d numbers; the others are NaN."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if (lengths == d).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), np.ones(len(lengths), bool)
    out, known = np.full((len(lengths), d), np.nan), np.zeros(len(lengths), bool)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) >= d and not any(x is None for x in v[:d]):
            out[i], known[i] = v[:d], True
    return out, known


def found_schema(qid: T.DataType, id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("qid", qid), T.StructField("id", id), T.StructField("distance", T.DoubleType())])


def range_search(
    collection: DataFrame,
    queries: DataFrame,
    threshold: float,
    metric: str = "euclidean",
    most: int | None = None,
    *,
    allow: Sequence[DataFrame] = (),
    deny: Sequence[DataFrame] = (),
    first_seen: bool = False,
    reservoir: int | None = None,
    strategy: str = "auto",
    telemetry: Telemetry | None = None,
) -> DataFrame:
    """``(qid, id, score)`` of all rows within the threshold: distance at most, or dot or cosine similarity at least.

    A negative Euclidean threshold keeps nothing.  ``allow`` and ``deny`` are id sets, which hold
    before the scan.  ``most`` keeps the first rows of a query by id; ``first_seen`` one row of each
    id, the best; ``reservoir`` the best rows of a query.  By Arrow only rows in
    range leave a task, of a reservoir only those that it can hold.
    """
    _check(metric, "range_search")
    rows = id_pass(collection, allow, deny)
    d = dimension_of(queries, "q")
    up = metrics.ascending(metric)
    inside = (lambda s: s <= threshold) if up else (lambda s: s >= threshold)  # never for what is no number
    found = []
    for block in query_blocks(queries, d):
        how = choose_strategy(block.count(), d) if strategy == "auto" else strategy
        if how == "arrow" and reservoir is not None and most is None and telemetry is None and _whole(rows.schema["id"].dataType):
            # a task keeps what a reservoir can hold, so what is in range need not leave it
            raw = metric in ("dot", "cosine")
            scored = _arrow_nearest(rows, block, metric, reservoir, raw=raw, within=threshold if up else -threshold, distinct=first_seen)
            found.append(scored.withColumnRenamed("distance", "score"))
        elif how == "arrow":
            scored = _arrow_range(rows, block, metric, threshold, telemetry)
            found.append(scored.withColumnRenamed("distance", "score"))
        else:
            found.append(numbers(_range_scores(rows, block, metric, d), "score").where(inside(F.col("score"))))
    out = _union(found)
    if first_seen:
        out = out.groupBy("qid", "id").agg((F.min if up else F.max)("score").alias("score"))
    if reservoir is not None:
        out = top_k_by(out, reservoir, score="score", ascending=up).select("qid", "id", "score")
    return out if most is None else top_k_by(out, most, score="id").select("qid", "id", "score")


def range_count(collection: DataFrame, queries: DataFrame, threshold: float, metric: str = "euclidean", telemetry: Telemetry | None = None) -> DataFrame:
    """``(qid, n)``: how many rows ``range_search`` finds for each query, none where it finds none.

    A pair whose coarse product already tells that it is in range, or out of it, gets no score, and
    no pair leaves its task; so what is counted may be a large part of all pairs.
    """
    _check(metric, "range_count")
    d = dimension_of(queries, "q")
    parts = [_arrow_range(collection, block, metric, threshold, telemetry, counts=True) for block in query_blocks(queries, d)]
    return _union(parts).groupBy("qid").agg(F.sum("n").alias("n"))


def _range_scores(collection: DataFrame, block: DataFrame, metric: str, d: int) -> DataFrame:
    scored = pairs(collection, block, metric, d, raw=True)
    return scored.withColumn("score", F.sqrt("score")) if metric == "euclidean" else scored


def range_mask(collection: DataFrame, queries: DataFrame, threshold: float, metric: str = "euclidean") -> DataFrame:
    """``(qid, id, mask)``: 1 for rows within the threshold, else 0."""
    d, up = dimension_of(queries, "q"), metrics.ascending(metric)

    def inside(q, x, *_):
        s = distances(q, x, metric) if metric == "euclidean" else raw_scores(q, x, metric)
        return (s <= threshold if up else s >= threshold).astype("int32")

    rows = collection.select("id", F.when(sound(F.lit(0.0), F.col("vector"), d).isNotNull(), F.col("vector")).alias("vector"))
    return _union([all_pairs(rows, block.select("qid", "q"), "mask", T.IntegerType(), inside, nulls=False) for block in query_blocks(queries, d)])


def rerank_scores(candidates: DataFrame, collection: DataFrame | VectorReader, queries: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``candidates(qid, id, ...)`` with their exact raw ``score``; candidates without a vector get the worst score, infinite, and ``present`` false.

    The vectors are those of a collection, or what a reader fetches (``readers``).
    """
    d = dimension_of(queries, "q")
    worst = float("inf") if metrics.ascending(metric) else float("-inf")
    vectors = collection if isinstance(collection, DataFrame) else collection.fetch(candidates)
    joined = candidates.join(vectors.select("id", F.col("vector").alias("_v")), "id", "left").join(queries.select("qid", F.col("q").alias("_q")), "qid")
    score = F.when(F.col("_v").isNotNull(), metrics.score(metric, F.col("_q"), F.col("_v"), d)).otherwise(F.lit(worst))
    return joined.select(*candidates.columns, score.alias("score"), F.col("_v").isNotNull().alias("present"))


def rerank_top_k(candidates: DataFrame, collection: DataFrame | VectorReader, queries: DataFrame, k: int, metric: str = "euclidean", skip_missing: bool = True, pad: bool = False) -> DataFrame:
    """``(qid, rank, id, score)``: the k best candidates of each query by exact score, ties by id.

    ``pad`` gives each query k rows: behind the last candidate rows without an id, of the worst score.
    """
    scored = rerank_scores(candidates, collection, queries, metric)
    if skip_missing:
        scored = scored.where("present")
    best = top_k_by(scored, k, score="score", ascending=metrics.ascending(metric)).select("qid", "rank", "id", "score")
    if not pad or check_k(k, "rerank_top_k") < 1:
        return best
    worst = float("inf") if metrics.ascending(metric) else float("-inf")
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(best, ["qid", "rank"], "left").select("qid", "rank", "id", F.coalesce("score", F.lit(worst)).alias("score"))


def knn_graph(collection: DataFrame, k: int = 15, metric: str = "euclidean", strategy: str = "auto") -> DataFrame:
    """``(src, rank, dst, distance)``: each row's k nearest others, Euclidean weights; cosine ones as chords of the unit sphere.

    Exact, so all pairs are scored, a block of queries at a time: for collections of some million
    rows.  ``hnsw.knn_graph`` and the inverted lists give approximate neighbours beyond that.
    """
    if metric not in ("euclidean", "cosine"):
        raise VectorError("unsupported_metric", "a neighbour graph takes euclidean and cosine", "knn_graph", metric=metric)
    if k < 1:
        raise VectorError("invalid_k", "k is at least 1", "knn_graph", k=k)
    queries = collection.select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    d = dimension_of(collection)
    found = []
    for block in query_blocks(queries, d):
        how = choose_strategy(block.count(), d) if strategy == "auto" else strategy
        # one more than k, for the row itself
        scored = _arrow_nearest(collection, block, metric, k + 1) if how == "arrow" else numbers(pairs(collection, block, metric, d))
        found.append(top_k_by(scored.where("qid <> id"), k))
    out = _union(found)
    weight = F.sqrt(F.greatest(F.lit(0.0), F.col("distance") * 2)) if metric == "cosine" else F.col("distance")
    return out.select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"), weight.alias("distance"))


def candidates(collection: DataFrame, queries: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``(qid, pos, id, vector, metadata)``: what an outside scorer gets; ``pos`` counts a query's candidates by id, from 0.

    With ``probes(qid, list_id)``, as ``ivf.probes_of`` gives them, the collection has ``list_id``, and a
    query's candidates are the rows of its lists; without, all rows.
    """
    from pyspark.sql.window import Window

    if probes is not None:
        kept = [c for c in ("vector", "metadata") if c in collection.columns]
        met = collection.join(probes.select("qid", "list_id"), "list_id")
        place = F.row_number().over(Window.partitionBy("qid").orderBy("id")) - 1
        return met.select("qid", place.alias("pos"), "id", *kept)

    pos = F.row_number().over(Window.partitionBy("qid").orderBy("id")) - 1
    kept = [c for c in ("vector", "metadata") if c in collection.columns]
    blocks = query_blocks(queries, dimension_of(queries, "q"))
    return _union([collection.join(F.broadcast(block.select("qid"))).select("qid", pos.alias("pos"), "id", *kept) for block in blocks])


def finalize(found: DataFrame, offered: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Results ``(qid, pos, distance)`` of an outside scorer as ``(qid, rank, id, distance)``; unknown places are skipped, and the filter holds here."""
    named = found.join(offered, ["qid", "pos"])
    named = named if where is None else named.where(where)
    return top_k_by(named.select("qid", "id", "distance"), k).select("qid", "rank", "id", "distance")


def observed(candidates: DataFrame, found: Callable[[DataFrame], DataFrame], name: str = "search") -> tuple[DataFrame, Observation]:
    """``found(candidates)`` and an observation, which after an action holds ``candidates_searched``: the rows that the search read.

    ``candidates`` is what an index leaves to score (a collection, the probed lists); nothing is
    run a second time to count it.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    return found(candidates.observe(seen, F.count(F.lit(1)).alias("candidates_searched"))), seen


def with_stats(results: DataFrame, seen: Observation, exhaustive: bool) -> tuple[list, dict]:
    """The rows of a search that was ``observed``, and beside them the candidates, the time of the search and whether it saw all rows."""
    import time

    began = time.perf_counter_ns()
    rows = results.collect()
    return rows, {"search_nanos": time.perf_counter_ns() - began, "is_exhaustive": exhaustive, **seen.get}
