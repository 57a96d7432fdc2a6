"""Walks that go on to another floor where an edge leads there."""

import duckdb
import pytest
from test_queries import SF, rows

from atrium.plans import catalog, simulation


@pytest.fixture(scope="module")
def two_floors(tmp_path_factory):
    """Floors 378 and 2878: the edge from the last node of the first finds its other end, and a walk goes over it."""
    at = str(tmp_path_factory.mktemp("floors"))
    part = f"select * replace (k as p_partkey) from (select * from '{SF}/part.parquet' limit 1) p, (select 151200 + range as k from range(400) union all select 1151200 + range from range(400))"
    duckdb.sql(f"copy ({part}) to '{at}/part.parquet' (format parquet)")
    duckdb.sql(f"copy (from '{SF}/customer.parquet') to '{at}/customer.parquet' (format parquet)")
    return at


@pytest.mark.parametrize("name", ["route_cumulative", "route_position_at"])
def test_walks_keep_their_own_order(spark, two_floors, name):
    c, q = duckdb.connect(), catalog.QUERIES[name]
    for t in ("part", "customer"):
        c.sql(f"create view {t} as from '{two_floors}/{t}.parquet'")
    want = c.sql(q.sql).df()
    assert c.sql("select count(*) from part").fetchall() == [(800,)] and len(want)
    assert rows(q.run(spark, two_floors).toPandas()) == rows(want)


def test_marks_of_one_walk_on_another(spark):
    walk = [(1, 1, 0.0, 0.0, 0.6, 0.0, 0.0, 0.6), (1, 5, 0.0, 9.0, 0.6, 9.0, 0.5, 1.1)]
    segments = spark.createDataFrame(walk, "floor_id long, seq long, ax double, ay double, bx double, by double, start_at double, end_at double")
    got = sorted((r.at, r.seq) for r in simulation.samples(segments).collect())
    assert got == [(0.0, 1), (0.25, 1), (0.5, 1), (0.5, 5), (0.6, 5), (0.75, 5), (1.0, 5), (1.1, 5)]
