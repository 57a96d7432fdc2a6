"""Small exact cases for the column builders and interval operators."""

import pytest
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import graph, spatial


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("v")).first().v


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_areas_and_lengths(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    assert one(spark, G.ring_area(square), a=1) == 100
    assert one(spark, G.perimeter(square), a=1) == 40
    assert one(spark, G.path_length(square), a=1) == 30
    assert one(spark, G.ring_area(ring((0, 0), (1, 1))), a=1) == 0
    triangle = ring((0, 0), (4, 0), (0, 3))
    assert one(spark, G.ring_area(triangle), a=1) == 6 and one(spark, G.perimeter(triangle), a=1) == 12


def test_projection_of_a_point_on_a_segment(spark):
    args = [F.lit(float(v)) for v in (3, 4, 0, 0, 10, 0)]
    assert one(spark, G.along(*args), a=1) == pytest.approx(0.3)
    assert one(spark, G.segment_distance(*args), a=1) == 4
    same = [F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)]
    assert one(spark, G.along(*same), a=1) == 0 and one(spark, G.segment_distance(*same), a=1) == 5


def test_snap_rounds_halves_up_below_zero(spark):
    assert one(spark, G.snap(F.lit(-2.5), 1.0), a=1) == -2
    assert one(spark, G.snap(F.lit(2.5), 1.0), a=1) == 3


def test_segment_across_a_box_and_a_disc(spark):
    lo, hi = G.segment_in_box(*[F.lit(float(v)) for v in (4, 6, 10, 6, 5, 5, 9, 9)])
    assert (one(spark, lo, a=1), one(spark, hi, a=1)) == (pytest.approx(1 / 6), pytest.approx(5 / 6))
    lo, hi = G.segment_in_disc(*[F.lit(float(v)) for v in (0, 0, 10, 0, 5, 0, 2)])
    assert (one(spark, lo, a=1), one(spark, hi, a=1)) == (pytest.approx(0.3), pytest.approx(0.7))


def test_interval_union(spark):
    parts = spark.createDataFrame([(1, 0.0, 0.2), (1, 0.1, 0.3), (1, 0.5, 0.6), (2, 0.0, 1.0)], "k int, lo double, hi double")
    merged = spatial.interval_union(parts, ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, 0.0, 0.3), (1, 0.5, 0.6), (2, 0.0, 1.0)]


def test_islands_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None)], "k int, i int, v string")
    assert [r.island for r in spatial.islands(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_disc_join_equals_all_pairs(spark):
    points = spark.range(60).select((F.col("id") % 2).alias("floor_id"), "id", ((F.col("id") * 37) % 50).cast("double").alias("x"), ((F.col("id") * 53) % 50).cast("double").alias("y"))
    discs = points.select("floor_id", F.col("id").alias("other"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.lit(3.0) + F.col("id") % 9).alias("r"))
    got = {(r.id, r.other) for r in spatial.disc_join(points, discs, F.col("r"), 5.0).collect()}
    p, d = points.collect(), discs.collect()
    want = {(a.id, b.other) for a in p for b in d if a.floor_id == b.floor_id and ((a.x - b.cx) ** 2 + (a.y - b.cy) ** 2) ** 0.5 <= b.r + 1e-8}
    assert got == want


def test_components_of_a_long_chain_and_a_lone_node(spark):
    nodes = spark.range(41).withColumnRenamed("id", "node_id")
    edges = spark.range(39).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = dict(map(tuple, graph.components(nodes, edges).collect()))
    assert set(got[i] for i in range(40)) == {0} and got[40] == 40


def test_routes_on_a_lattice(spark):
    n = 12
    cells = spark.range(n * n).select(F.col("id").alias("a"))
    right = cells.where(f"a % {n} < {n - 1}").select("a", (F.col("a") + 1).alias("b"), (F.col("a") * 2).alias("edge_id"))
    down = cells.where(f"a < {n * (n - 1)}").select("a", (F.col("a") + n).alias("b"), (F.col("a") * 2 + 1).alias("edge_id"))
    arcs = right.unionByName(down).select("a", "b", "edge_id", F.lit(1.0).alias("cost"), F.lit(1.0).alias("distance"))
    got = {r.node_id: r for r in graph.routes(cells.where("a = 0").select(F.col("a").alias("source"), F.col("a").alias("node_id")), arcs).collect()}
    assert all(got[i].cost == i // n + i % n for i in range(n * n)) and len(got[n * n - 1].path) == 2 * (n - 1)
    near = graph.routes(cells.where("a = 0").select(F.col("a").alias("source"), F.col("a").alias("node_id")), arcs, within=3.0)
    assert near.count() == 10


def test_routes_of_least_cost_and_least_path(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0, 1), (1, 2, 1.0, 2), (0, 2, 5.0, 3), (0, 3, 1.0, 4), (3, 2, 1.0, 5), (2, 0, 1.0, 6)], "a long, b long, cost double, edge_id long").withColumn("distance", F.col("cost"))
    start = spark.createDataFrame([(7, 0)], "source long, node_id long")
    assert {r.node_id: (r.cost, r.path) for r in graph.routes(start, arcs).collect()} == {0: (0.0, []), 1: (1.0, [1]), 2: (2.0, [1, 2]), 3: (1.0, [4])}
