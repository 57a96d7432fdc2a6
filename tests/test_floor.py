"""Floor geometry against small plans with known answers, and against a plain version without bins."""

import random

import pytest
from pyspark.sql import functions as F

from atrium.operators import floor

V = "floor_id long, polygon_id long, role string, ring int, i int, x double, y double"
C = "floor_id long, path_id long, seg int, kind string, width double, ax double, ay double, bx double, by_ double"


def ring(n, role, points, hole=(), floor_id=1):
    return [(floor_id, n, role, r, i, float(x), float(y)) for r, ps in enumerate([points, *hole]) for i, (x, y) in enumerate(ps)]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.fixture(scope="module")
def plan(spark):
    rows = ring(1, "boundary", box(0, 0, 20, 20)) + ring(2, "walkable", box(1, 1, 19, 19), [box(14, 2, 16, 4)]) + ring(3, "restricted", box(8, 8, 10, 10)) + ring(4, "nonWalkable", box(12, 12, 14, 14))
    rows += ring(5, "boundary", box(0, 0, 10, 10), floor_id=2)
    return floor.of_rings(spark.createDataFrame(rows, V), spark.createDataFrame([(1, 9, 0, "wall", 0.2, 5.0, 0.0, 5.0, 10.0)], C))


def test_conflicts_in_their_order(spark, plan):
    points = [(1, 1, 3.0, 3.0), (2, 1, 21.0, 3.0), (3, 1, 5.05, 3.0), (4, 1, 9.0, 9.0), (5, 1, 13.0, 13.0), (6, 1, 0.5, 0.5), (7, 2, 5.0, 5.0), (8, 3, 1.0, 1.0), (9, 1, 8.0, 9.0), (10, 1, 15.0, 3.0), (11, 1, 14.0, 3.0), (12, 1, 20.0, 20.0)]
    got = {r.id: (r.conflict, r.conflict_off_path) for r in floor.conflicts(spark.createDataFrame(points, "id long, floor_id long, x double, y double"), ["id"], plan).collect()}
    assert got == {
        1: (None, None), 2: ("outside-building",) * 2, 3: ("inside-wall",) * 2, 4: ("restricted-area",) * 2, 5: ("non-walkable-area",) * 2, 6: ("non-walkable-area", None),
        7: ("missing-walkable-geometry", None), 8: ("missing-building-boundary",) * 2, 9: ("restricted-area",) * 2, 10: ("non-walkable-area", None), 11: (None, None), 12: ("non-walkable-area", None),
    }


def test_valid_parts_of_segments(spark, plan):
    lines = spark.createDataFrame([(1, 1, 2.0, 9.0, 12.0, 9.0), (2, 1, 2.0, 15.0, 6.0, 15.0), (3, 1, 15.0, 15.0, 25.0, 15.0), (4, 3, 0.0, 0.0, 1.0, 0.0)], "id long, floor_id long, ax double, ay double, bx double, by double")
    got = {}
    for r in floor.valid_intervals(lines, ["id"], plan).orderBy("id", "lo").collect():
        got.setdefault(r.id, []).append((round(r.lo, 6), round(r.hi, 6)))
    assert got == {1: [(0.0, 0.29), (0.31, 0.6), (0.8, 1.0)], 2: [(0.0, 1.0)], 3: [(0.0, 0.4)]}


def test_sight_stops_at_a_thin_wall(spark, plan):
    pairs = [(1, 1, 4.0, 5.0, 6.0, 5.0), (2, 1, 4.0, 12.0, 6.0, 12.0), (3, 1, 4.0, 5.0, 4.0, 5.0), (4, 1, 9.0, 9.0, 9.0, 9.0), (5, 1, 7.0, 7.0, 7.0, 17.0), (6, 1, 8.5, 7.0, 8.5, 17.0), (7, 1, 0.2, 0.2, 3.0, 0.2)]
    seen = floor.visible(spark.createDataFrame(pairs, "id long, floor_id long, ax double, ay double, bx double, by double"), ["id"], plan)
    assert sorted(r.id for r in seen.collect()) == [2, 3, 5, 7]


def plain_conflict(x, y, polygons, walls):
    def dist(a, b):
        (ax, ay), (bx, by) = a, b
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5

    def inside(points):
        sides = list(zip(points, points[1:] + points[:1], strict=True))
        odd = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in sides) % 2 == 1
        return odd or any(dist(a, b) < 1e-8 for a, b in sides)

    if not any(inside(p) for role, p in polygons if role == "boundary"):
        return "outside-building"
    if any(dist(a, b) <= w / 2 + 1e-8 for a, b, w in walls):
        return "inside-wall"
    return "restricted-area" if any(inside(p) for role, p in polygons if role == "restricted") else None


def test_bins_give_what_a_plain_search_gives(spark):
    rng = random.Random(4)
    polygons = [("boundary", box(0, 0, 200, 200))] + [("restricted", [(x, y), (x + rng.uniform(0.1, 30), y + 1), (x + 2, y + rng.uniform(2, 20))]) for x, y in ((rng.uniform(0, 180), rng.uniform(0, 180)) for _ in range(60))]
    walls = [((x, y), (x + rng.uniform(-20, 20), y + rng.uniform(1, 20)), 0.4) for x, y in ((rng.uniform(20, 180), rng.uniform(0, 180)) for _ in range(20))]
    rows = [r for n, (role, p) in enumerate(polygons) for r in ring(n, role, p)]
    shapes = floor.of_rings(spark.createDataFrame(rows, V), spark.createDataFrame([(1, i, 0, "wall", w, *a, *b) for i, (a, b, w) in enumerate(walls)], C))
    points = [(i, 1, rng.uniform(-5, 205), rng.uniform(-5, 205)) for i in range(600)]
    got = {r.id: r.conflict_off_path for r in floor.conflicts(spark.createDataFrame(points, "id long, floor_id long, x double, y double"), ["id"], shapes).collect()}
    assert got == {i: plain_conflict(x, y, polygons, walls) for i, _, x, y in points}
    lines = spark.createDataFrame([(i, 1, x, y, x + rng.uniform(-15, 15), y + rng.uniform(-15, 15)) for i, _, x, y in points[:60]], "id long, floor_id long, ax double, ay double, bx double, by double")
    seen = {r.id for r in floor.visible(lines, ["id"], shapes).collect()}
    for r in lines.collect():
        steps = [plain_conflict(r.ax + k / 400 * (r.bx - r.ax), r.ay + k / 400 * (r.by - r.ay), polygons, walls) for k in range(401)]
        assert not (r.id in seen and any(steps)), r
    assert 0 < len(seen) < 60 and lines.where(~F.col("id").isin(list(seen))).count() == 60 - len(seen)
