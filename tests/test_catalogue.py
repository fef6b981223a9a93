"""Every query of the catalogue against its SQL, by value."""

import duckdb
import pytest

from vectide.operators import search
from vectide.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    assert rows(got) == rows(want)


def neighbours(rows, by, to):
    found = {}
    for r in rows:
        found.setdefault(r[by], set()).add(r[to])
    return found


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["hnsw_knn", "hnsw_replayed_knn", "hnsw_compacted_knn", "hnsw_knn_graph", "ivf_trained_knn", "ivfpq_knn"])
def test_recall_is_nine_tenths(spark, name, sf):
    sf = f"/root/testdata/{sf}"
    v = catalogue.plain(spark, sf)
    rows = catalogue.QUERIES[name](spark, sf).collect()
    if name == "hnsw_knn_graph":
        got, want = neighbours(rows, "src", "dst"), neighbours(search.knn_graph(v, 10).collect(), "src", "dst")
    else:
        live = v.where("id % 10 <> 3") if name == "hnsw_compacted_knn" else v
        got, want = neighbours(rows, "qid", "id"), neighbours(search.batch_knn(live, catalogue.probes(v), 10).collect(), "qid", "id")
        assert name != "hnsw_compacted_knn" or not any(i % 10 == 3 for found in got.values() for i in found)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
