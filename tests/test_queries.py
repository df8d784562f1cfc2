"""Every query with an SQL counterpart gives its rows."""

import math
import os

import duckdb
import pytest

from quarry import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = engine.queries(), engine.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = sorted(str(sorted((k, plain(v)) for k, v in r.asDict(True).items())) for r in QUERIES[name](spark, SF).collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [c[0] for c in cursor.description]
        assert found == sorted(str(sorted((k, plain(v)) for k, v in zip(names, r))) for r in cursor.fetchall())
    else:
        assert isinstance(found, list)
