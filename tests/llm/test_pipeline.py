"""The pipeline as a whole, and its queries against SQL, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from atrium.llm import queries

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_columns_and_drops_for_cause(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        then = stage(spark, now, SF)
        if name != "mixing":
            assert then.columns == docs.columns
        ids = {r.doc_id for r in then.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in now.select("doc_id").collect()} and len(ids) == then.count()
        now = then
    assert 0 < now.count() < docs.count()
    # After the duplicate stages no two texts are equal.
    assert now.select("text").distinct().count() == now.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
