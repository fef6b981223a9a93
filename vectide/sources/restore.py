"""Indexes of records that come from elsewhere.

An exchange file holds records and their description, but no index.  ``restore`` makes a durable
collection of them and, by its kind, trains lists or builds a graph anew, with the stored settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.operators import hnsw
from vectide.schema import VectorError
from vectide.sources.collection import DurableCollection, import_json
from vectide.sources.graphs import DurableGraph
from vectide.sources.listed import ListIndex

#: Lists, where the settings don't say how many.
LISTS = 256


def restore(spark: SparkSession, path: str, folder: str, kind: str | None = None) -> tuple[DurableCollection, ListIndex | DurableGraph | None]:
    """The collection of the JSON records at ``path``, in ``folder``, and its index: ``ivf`` and ``hnsw`` have one.

    Of records with one id the last counts.  Another kind than ``kind`` and no records are errors.
    """
    records, config = import_json(spark, path, kind)
    collection = DurableCollection.create(spark, f"{folder.rstrip('/')}/collection", config)
    collection.upsert(records)
    collection.compact()
    return collection, build_index(collection, f"{folder.rstrip('/')}/index")


def build_index(collection: DurableCollection, path: str) -> ListIndex | DurableGraph | None:
    """The index that the collection's kind asks for, with the collection's settings; None for flat kinds."""
    config = collection.config
    if config.kind == "ivf":
        n = collection.count()
        return ListIndex.create(collection, path, max(1, min(n, config.settings.get("nlist", LISTS))))
    if config.kind == "hnsw":
        known = {name: config.settings[name] for name in vars(hnsw.Settings()) if name in config.settings}
        rows: DataFrame = collection.records().select("id", "vector")
        return DurableGraph.create(collection.spark, path, rows, config.metric, hnsw.Settings(**known), dimension=config.dimension)
    if not config.kind.startswith("flat"):
        raise VectorError("unreadable_format", "no such kind of collection", "restore", kind=config.kind)
    return None
