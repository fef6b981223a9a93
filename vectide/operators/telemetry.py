"""Counters that the tasks of a search add to, and one row of them.

A search that is given a ``Telemetry`` counts what it does where it does it.  The counters are
Spark's accumulators: they are filled once an action has run, and a task that runs again counts
again.  ``row`` gives them as a table of one row, to be kept beside other queries'.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

#: What is counted: nodes whose distance a graph search took; lists met by queries, and rows scored in
#: them; pairs of a range search that were scored, or passed over by their norms; rows found.
COUNTERS = ("nodes_visited", "lists_probed", "rows_scored", "range_scored", "range_skipped", "found")


class Telemetry:
    def __init__(self, spark: SparkSession):
        self.spark, self._began = spark, time.perf_counter_ns()
        for name in COUNTERS:
            setattr(self, name, spark.sparkContext.accumulator(0))

    def counters(self) -> dict:
        """Only the accumulators, which tasks may hold."""
        return {name: getattr(self, name) for name in COUNTERS}

    def values(self) -> dict[str, int]:
        return {name: getattr(self, name).value for name in COUNTERS}

    def row(self) -> DataFrame:
        """One row: the counters, and the nanoseconds since this telemetry began."""
        values = self.values() | {"nanos": time.perf_counter_ns() - self._began}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} long" for name in values))
