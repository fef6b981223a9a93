"""Compressed vector codes: a codebook for each part, nearest entries by VA-file filtering.

Vectors become whole numbers, ``floor(scale * x)``, and are cut into equal consecutive parts.  Each
part position has a codebook that begins with the vectors of the smallest ids and is bettered by
rounds of assignment and means, rounded down.

The nearest entry of a part is found as in a vector-approximation file.  Each coordinate of the
entries is quantised to ``BITS`` bits: cells of about equally many entries, with the least and the
largest coordinate that occur in each.  For each part that asks, a look-up table of its coordinates
against the cells gives the smallest and largest squared distance that a cell allows; summed by
the entries' cells they bound each entry's distance.  Only entries whose lower bound doesn't exceed
the smallest upper bound are refined by exact integer distances; ties go to the lower index.

Rows stay where they are.  A round moves sums by task, part, entry and coordinate, which Spark adds
up; the driver and the tasks hold the codebooks, ``entries`` x dimension numbers, whatever the rows.

Nulls and odd input.  Rows whose vector is null or holds a null, NaN or infinity are dropped, and so
are those whose length isn't the most frequent one (of two, the longer).  A dimension that the parts
don't divide is filled up with zeros.  Scaled components are held within ``LIMIT``, so that squared
distances fit 64 bits.  Repeated rows count repeatedly; null ids come last, and of equal ids the
smaller vector comes first.  With fewer rows than entries the codebooks are shorter.  Without rows
there is no codebook, and nothing is encoded.  Other columns pass through; those named like the
added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import cleared, joined_by_size, stored

#: Bits of an approximated coordinate.
BITS = 3
#: The largest scaled component.
LIMIT = 1 << 26
#: Parts that are compared at once.
_STEP = 4096


class Cells:
    """The approximation of a codebook (entries x coordinates): each coordinate's cell, and the cells' least and largest values."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        k, d = entries.shape
        n = 1 << bits
        self.code = np.empty((k, d), np.int64)
        self.low, self.high = np.zeros((d, n), np.int64), np.zeros((d, n), np.int64)
        for j in range(d):
            x = self.entries[:, j]
            edges = np.sort(x)[[k * c // n for c in range(1, n)]]
            self.code[:, j] = np.searchsorted(edges, x, "right")
            for c in np.unique(self.code[:, j]):
                inside = x[self.code[:, j] == c]
                self.low[j, c], self.high[j, c] = inside.min(), inside.max()

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows x entries) of the squared distances, by look-up tables."""
        lower, upper = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), np.int64)
        for j in range(x.shape[1]):
            under, over = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            lower += (near * near)[:, self.code[:, j]]
            upper += (far * far)[:, self.code[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, its squared distance, and how many entries were refined."""
        at, error, refined = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i in range(0, len(x), _STEP):
            part = x[i : i + _STEP]
            lower, upper = self.bounds(part)
            overlap = lower <= upper.min(axis=1, keepdims=True)
            rows, cols = np.nonzero(overlap)
            away = part[rows] - self.entries[cols]
            exact = np.einsum("ij,ij->i", away, away)
            n = overlap.sum(axis=1)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            best = np.minimum.reduceat(exact, starts)
            at[i : i + _STEP] = np.minimum.reduceat(np.where(exact == best[rows], cols, len(self.entries)), starts)
            error[i : i + _STEP], refined[i : i + _STEP] = best, n
        return at, error, refined


def scaled(df: DataFrame, vector_col: str, parts: int, scale: int, out_col: str = "scaled") -> DataFrame:
    """df without its vector, with the whole numbers ``out_col``; rows without a whole vector are gone."""
    df = cleared(df, out_col)
    value = lambda x: x.cast("double")
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    whole = df.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    length = F.size(vector_col)
    usual = whole.groupBy(length.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = max(1, -(-(usual.n if usual else 0) // parts)) * parts
    numbers = F.transform(vector_col, lambda x: F.floor(F.greatest(F.least(value(x) * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    filled = F.concat(numbers, F.array_repeat(F.lit(0), F.lit(width) - length))
    return whole.where(length == (usual.n if usual else -1)).select(*[c for c in df.columns if c != vector_col], filled.alias(out_col))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def fit(rows: DataFrame, id_col: str, parts: int, entries: int, rounds: int, scaled_col: str = "scaled") -> list[np.ndarray]:
    """The codebooks, one (entries x coordinates) array a part, from the whole table ``rows`` of scaled vectors."""
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), scaled_col).limit(entries).select(scaled_col).collect()
    if not first:
        return []
    books = [b.copy() for b in np.split(np.array([r[0] for r in first], np.int64), parts, axis=1)]
    for _ in range(rounds):
        for r in _sums(rows.select(scaled_col), books).collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def _sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(part, entry, place, total, n)``: sums of the coordinates of the parts that each entry is nearest to."""
    parts, (k, d) = len(books), books[0].shape

    def run(batches):
        import pyarrow as pa

        cells = [Cells(b) for b in books]
        total, n = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * d)
            for p, c in enumerate(cells):
                part = x[:, p * d : (p + 1) * d]
                at, _, _ = c.nearest(part)
                np.add.at(total[p], at, part)
                n[p] += np.bincount(at, minlength=k)
        p, e = np.nonzero(n)
        columns = [np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p)), total[p, e].ravel(), np.repeat(n[p, e], d)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns[:3]), *(pa.array(c) for c in columns[3:])], names=["part", "entry", "place", "total", "n"])

    sums = rows.mapInArrow(run, "part int, entry int, place int, total long, n long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def encode(rows: DataFrame, books: list[np.ndarray], scaled_col: str = "scaled") -> DataFrame:
    """rows without the scaled vector, with ``code binary`` (a byte a part, or two), ``error long`` and ``refined long``, the exact distances taken."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = cleared(rows, "code", "error", "refined")
    kept = [c for c in rows.columns if c != scaled_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("refined", T.LongType())])
    if not books:
        return rows.where("false").select(*kept, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("refined"))
    parts, (k, d) = len(books), books[0].shape
    unit = np.uint8 if k <= 256 else np.dtype(">u2")
    at, keep_at = rows.columns.index(scaled_col), [rows.columns.index(c) for c in kept]

    def run(batches):
        import pyarrow as pa

        cells, names = [Cells(b) for b in books], to_arrow_schema(schema).names
        for batch in batches:
            x = _matrix(batch.column(at), parts * d)
            code, error, refined = np.empty((len(x), parts), unit), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p, c in enumerate(cells):
                code[:, p], e, n = c.nearest(x[:, p * d : (p + 1) * d])
                error += e
                refined += n
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep_at), codes, pa.array(error), pa.array(refined)], names=names)

    return rows.mapInArrow(run, schema)


def label_errors(encoded: DataFrame, label_col: str) -> DataFrame:
    """``encoded`` with ``label_error``: the errors of all rows of a label added up, null being a label of its own."""
    encoded = stored(cleared(encoded, "label_error"), "codes")
    sums = encoded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    sums = stored(sums, "label-errors")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return joined_by_size(encoded, sums, F.col(label_col).eqNullSafe(F.col("_label")), "_n", total).drop("_label", "_n")


def digest(books: list[np.ndarray]) -> str | None:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest() if books else None
