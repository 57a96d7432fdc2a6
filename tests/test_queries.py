"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from atrium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or pd.isna(v):
        return "none"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    q = catalog.QUERIES[name]
    got = q.run(spark, SF).toPandas()
    if q.sql:
        assert rows(got) == rows(duck.sql(q.sql).df())
