"""Coverage kept current: equal to a full count after each batch, local work, and going on after a break."""

import pytest
from pyspark.sql import functions as F

from atrium.operators import floor, spatial
from atrium.plans import coverage
from atrium.streaming import changes
from atrium.streaming.maintained import BEACON, Maintained

EDIT = "seq long, beacon_id long, floor_id long, x double, y double, radius double, enabled boolean"


def plan(spark, side=300.0):
    rows = [(f, 1000 + f * 10 + k, role, 0, i, x, y) for f in (0, 1) for k, role in enumerate(("boundary", "walkable")) for i, (x, y) in enumerate([(-3.0, 0.0), (side, 0.0), (side, side), (-3.0, side)])]
    vertices = spark.createDataFrame(rows, "floor_id long, polygon_id long, role string, ring int, i int, x double, y double")
    caps = spark.createDataFrame([(0, 1, 0, "wall", 0.2, 50.0, 0.0, 50.0, side)], "floor_id long, path_id long, seg int, kind string, width double, ax double, ay double, bx double, by_ double")
    return vertices, floor.of_rings(vertices, caps)


def full(kept, cells):
    discs = kept.beacons().where("enabled").select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", F.col("radius").alias("marginal"))
    n = coverage.count_of(cells, coverage.seen_from(cells, discs, kept.shapes))
    return {(r.floor_id, r.col, r.row_no): r.n for r in n.collect()}


def counts(kept):
    return {(r.floor_id, r.col, r.row_no): r.n for r in kept.counts().collect()}


def files(at):
    return {str(p) for p in (at / "counts").rglob("*.parquet")}


def test_batches_count_what_they_touch_and_go_on_after_a_break(spark, tmp_path, monkeypatch):
    vertices, shapes = plan(spark)
    cells = floor.conflicts(coverage.grid(vertices, 6.0), coverage.CELL_KEY, shapes).where("conflict is null").select(*coverage.CELL_KEY, "x", "y").cache()
    # The grid covers the whole floor of 303 m, walls apart.
    assert cells.where("floor_id = 1").count() == 51 * 50 and cells.agg(F.max("x")).first()[0] > 296
    beacons = spark.createDataFrame([(i % 2, i, 7.0 * (i * 37 % 43), 7.0 * (i * 53 % 43), 6.0, i % 5 > 0) for i in range(120)], BEACON)
    at = tmp_path / "deployment"
    kept = Maintained(spark, str(at), shapes, 50.0)
    assert kept.version() is None
    kept.start(cells, beacons)
    assert kept.version() == -1 and counts(kept) == full(kept, cells)
    batches = [
        [(1, 3, None, 200.0, 200.0, None, None), (2, 3, None, 203.0, None, None, None), (3, 999, None, 1.0, 1.0, None, None)],
        [(4, 13, None, None, None, None, False), (5, 200, 1, 48.0, 20.0, 9.0, None), (6, 15, None, None, None, None, True)],
        [(7, 200, 0, None, None, None, None), (8, 11, None, None, None, 6.0, None)],
        [(9, 12, None, float("nan"), 3.0, None, None)],
    ]
    edits = tmp_path / "edits"
    stream = lambda: spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(str(edits))
    spark.createDataFrame(batches[0], EDIT).coalesce(1).write.mode("append").parquet(str(edits))
    before = files(at)
    kept.follow(stream())
    assert kept.version() == 0 and counts(kept) == full(kept, cells)
    # Regions that no disc touches keep their files.
    assert len(before - files(at)) <= 8 < len(before & files(at))

    real = Maintained._done
    monkeypatch.setattr(Maintained, "_done", lambda self, number, changed, anew: (_ for _ in ()).throw(RuntimeError("lost")))
    spark.createDataFrame(batches[1], EDIT).coalesce(1).write.mode("append").parquet(str(edits))
    with pytest.raises(Exception, match="lost"):
        kept.follow(stream())
    assert kept.version() == 0
    monkeypatch.setattr(Maintained, "_done", real)
    for more in batches[2:]:
        spark.createDataFrame(more, EDIT).coalesce(1).write.mode("append").parquet(str(edits))
    again = Maintained(spark, str(at), shapes, 50.0)
    again.follow(stream())
    assert again.version() == 3 and counts(again) == full(again, cells)
    told = {r.batch: r for r in again.versions().collect()}
    assert told[-1].cells == cells.count()
    assert [told[k].changed for k in range(4)] == [1, 3, 1, 0]
    assert all(told[k].cells < cells.count() / 4 for k in range(4)) and told[3].cells == 0
    # A batch that is done is not done again.
    again.apply(spark.createDataFrame(batches[1], EDIT), 1)
    assert again.version() == 3


def test_grid_with_a_cell_size_of_each_floor_and_without_a_boundary(spark):
    v = spark.createDataFrame([(f, 1, role, 0, i, x, y) for f, role in ((0, "boundary"), (1, "boundary"), (2, "walkable")) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)])], "floor_id long, polygon_id long, role string, ring int, i int, x double, y double")
    sizes = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 1.0)], "floor_id long, cell double")
    got = {r.floor_id: (r.n, r.x, r.y) for r in coverage.grid(v, cells=sizes).groupBy("floor_id").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).collect()}
    assert got == {0: (40, 9.5, 3.5), 1: (3, 10.0, 2.0)}


def test_nearest_ends_with_points_and_targets_without_a_place(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, None, 1.0), (3, 0, nan, 1.0), (4, 0, 5000.0, 0.0), (5, 1, 0.0, 0.0), (6, 2, 0.0, 0.0)], "id long, floor_id long, x double, y double")
    targets = spark.createDataFrame([(10, 0, 3.0, 4.0), (11, 0, None, 0.0), (12, 0, 0.0, float("inf")), (13, 1, nan, 0.0)], "t long, floor_id long, nx double, ny double")
    c = F.col
    got = spatial.nearest(points, "id", targets, "t", F.sqrt((c("x") - c("nx")) ** 2 + (c("y") - c("ny")) ** 2), (c("nx"), c("ny"), c("nx"), c("ny")))
    assert sorted((r.id, r.t, r.dist) for r in got.collect()) == [(1, 10, 5.0), (2, None, None), (3, None, None), (4, 10, round((4997.0**2 + 16) ** 0.5, 9))]


def test_a_table_goes_on_where_its_stream_stopped(spark, tmp_path):
    at, src = str(tmp_path / "table"), str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "k long, n long, v string").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("k long, n long, v string").option("maxFilesPerTrigger", 1).parquet(src)
    put([(k, k, "a") for k in range(100)])
    first = {r.k: r.v for r in changes.kept_current(stream(), ["k"], "n", at).collect()}
    before = {str(p) for p in (tmp_path / "table" / "rows").rglob("*.parquet")}
    put([(5, 500, "b"), (None, 1, "c")])
    put([(5, 400, "late"), (700, 1, "d"), (None, 2, "e")])
    then = {r.k: r.v for r in changes.kept_current(stream(), ["k"], "n", at).collect()}
    assert then == first | {5: "b", 700: "d", None: "e"}
    after = {str(p) for p in (tmp_path / "table" / "rows").rglob("*.parquet")}
    assert len(before & after) > len(before) / 2
