"""Scans of inverted lists: queries and the lists that each probes, scored where the rows stand.

A scan takes the queries in blocks.  A block's bytes count its vectors, its probes and what the
scorer keeps for each query, so ``QUERY_BYTES`` holds for all that is sent to a task.  The probed
lists prune the rows before (a broadcast of list numbers, which prunes the files of a table that is
partitioned by ``list_id``).  In a task the rows of an Arrow batch are taken list by list, and each
list is scored against the queries that probe it; only each query's k best of a list leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.operators.search import PAIRS, found_schema, nearest_of, query_blocks
from vectide.operators.telemetry import Telemetry

#: True of all lists.  A broadcast that is filtered prunes the files of what it is joined with; one that is not doesn't.
ANY_LIST = "list_id >= -2147483648"


@dataclass
class Block:
    """A block of queries, collected: ids, vectors (n, d), and for each probed list the places of the queries that probe it."""

    qids: list
    kind: T.DataType
    vectors: np.ndarray
    by_list: dict[int, np.ndarray]


def blocks(queries: DataFrame, d: int, probes: Callable[[DataFrame], DataFrame], nprobe: int, extra: int = 0) -> Iterator[Block]:
    """Blocks of ``queries(qid, q)``; ``probes(block)`` gives ``(qid, list_id)``, ``extra`` the bytes that a scorer keeps for each query."""
    for part in query_blocks(queries, d + 3 * nprobe, extra):
        rows = part.select("qid", "q").collect()  # QUERY_BYTES, with its probes
        place = {r.qid: i for i, r in enumerate(rows)}
        by_list: dict[int, list[int]] = {}
        for r in probes(part).collect():
            by_list.setdefault(r.list_id, []).append(place[r.qid])
        vectors = np.array([r.q for r in rows], float).reshape(len(rows), -1)
        yield Block([r.qid for r in rows], part.schema["qid"].dataType, vectors, {i: np.array(sorted(q)) for i, q in by_list.items()})


def scan(rows: DataFrame, content: str, block: Block, decode: Callable, score: Callable, k: int, telemetry: Telemetry | None = None) -> DataFrame:
    """``(qid, id, distance)``: each query's k best rows of each list that it probes and each batch.

    ``rows(list_id, id, <content>)``; ``decode`` turns a batch's content column into an array, and
    ``score(content, queries, list_id)`` gives distances (queries, rows).
    """
    wanted = rows.sparkSession.createDataFrame([(int(i),) for i in block.by_list], "list_id int").where(ANY_LIST)
    rows = rows.select("list_id", "id", content).join(F.broadcast(wanted), "list_id", "left_semi")
    schema, pick = found_schema(block.kind, rows.schema["id"].dataType), nearest_of(k)
    count = telemetry.counters() if telemetry else None

    def run(batches):
        import pyarrow as pa

        names = pa.array(block.qids, to_arrow_schema(schema).field("qid").type)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(lists, kind="stable")
            values = decode(batch.column(2))
            starts = np.flatnonzero(np.diff(lists[order], prepend=lists[order[0]] - 1))
            found: list[tuple] = []  # many short lists make one batch of results
            waiting = 0

            def batch_of(found, ids=batch.column(1)):
                q, at, d = (np.concatenate(c) for c in zip(*found))
                return pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(at)), pa.array(d)], names=["qid", "id", "distance"])

            for a, b in zip(starts, [*starts[1:], len(order)]):
                asking, at = block.by_list[int(lists[order[a]])], order[a:b]
                if count:
                    count["lists_probed"].add(len(asking))
                    count["rows_scored"].add(len(asking) * int(b - a))
                step = max(1, PAIRS // (b - a))
                for i in range(0, len(asking), step):
                    d = score(values[at], asking[i : i + step], int(lists[order[a]]))
                    q, n = pick(d)
                    if len(q):
                        found.append((asking[i + q], at[n], d[q, n]))
                        waiting += len(q)
                    if waiting >= PAIRS:
                        yield batch_of(found)
                        found, waiting = [], 0
            if found:
                yield batch_of(found)

    return rows.mapInArrow(run, schema)
