"""Every query of the catalog against DuckDB on the smallest tables."""

import duckdb
import pytest

from grainline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow ones are covered by tests on small streams.
SLOW = {"learned_roundtrip_random_forest", "learned_roundtrip_decision_tree", "learned_roundtrip_naive_bayes", "learned_roundtrip_support_vectors", "learned_roundtrip_neural_net", "store_forward", "store_backward"}


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    q = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=str)
