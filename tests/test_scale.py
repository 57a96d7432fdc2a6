"""Rows, folders and plans that must not come together in one task or in the driver as tables grow."""

from pyspark.sql import functions as F

from atrium.operators import floor
from atrium.plans import coverage, placement
from atrium.streaming.maintained import BEACON, BUCKETS, Maintained

VERTEX = "floor_id long, polygon_id long, role string, ring int, i int, x double, y double"
CAPSULE = "floor_id long, path_id long, seg int, kind string, width double, ax double, ay double, bx double, by_ double"


def plan(spark, floors, side):
    rows = [(f, 1000 + f * 10 + k, role, 0, i, x, y) for f in range(floors) for k, role in enumerate(("boundary", "walkable")) for i, (x, y) in enumerate([(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)])]
    return spark.createDataFrame(rows, VERTEX)


def test_folders_of_counts_do_not_grow_with_the_regions(spark, tmp_path):
    vertices = plan(spark, 6, 40.0)
    shapes = floor.of_rings(vertices, spark.createDataFrame([], CAPSULE))
    kept = Maintained(spark, str(tmp_path / "d"), shapes, 8.0)
    kept.start(coverage.grid(vertices, 4.0).select(*coverage.CELL_KEY, "x", "y"), spark.createDataFrame([(0, 1, 10.0, 10.0, 6.0, True)], BEACON))
    before = {r[:3]: r.n for r in kept.counts().select("floor_id", "col", "row_no", "n").collect()}
    assert kept.counts().select("floor_id", "region").distinct().count() == 150 > BUCKETS
    assert len([p for p in (tmp_path / "d" / "counts").rglob("*") if p.is_dir()]) <= BUCKETS + 1
    kept.apply(spark.createDataFrame([(1, 1, None, None, None, None, False)], "seq long, beacon_id long, floor_id long, x double, y double, radius double, enabled boolean"), 0)
    after = {r[:3]: r.n for r in kept.counts().select("floor_id", "col", "row_no", "n").collect()}
    assert sum(before.values()) > 0 and after == dict.fromkeys(before, 0)


def test_cells_of_many_floors_are_made_in_many_tasks(spark):
    cells = coverage.grid(plan(spark, 40, 20.0))
    tasks = cells.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in tasks) == 4000 and len(tasks) > 1 and max(r.n for r in tasks) < 3000


def test_quality_facts_are_worked_out_one_by_one(spark):
    plan = placement.quality_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_capsules_are_cut_piece_by_piece(spark):
    # A path with a bend at (10, 10): its two parts share the circle there, which cuts a line once. Side lines and the ring are cut too.
    caps = spark.createDataFrame([(0, 5, 0, "path", 2.0, 0.0, 10.0, 10.0, 10.0), (0, 5, 1, "path", 2.0, 10.0, 10.0, 20.0, 10.0), (0, 6, 0, "wall", 2.0, 3.0, 30.0, 3.0, 30.0)], CAPSULE)
    lines = spark.createDataFrame([(1, 0, 10.0, 0.0, 10.0, 40.0), (2, 0, 0.0, 30.0, 40.0, 30.0)], "k long, floor_id long, ax double, ay double, bx double, by double")
    got = sorted((r.k, round(r.t * 40, 6)) for r in floor.cuts(lines, ["k"], floor.of_rings(plan(spark, 1, 36.0), caps)).where("t > 0 and t < 1").distinct().collect())
    assert got == [(1, 9.0), (1, 11.0), (1, 36.0), (2, 2.0), (2, 4.0), (2, 36.0)]
    circles = floor._outlines(floor.of_rings(plan(spark, 1, 36.0), caps))[1]
    assert circles.count() == 4
