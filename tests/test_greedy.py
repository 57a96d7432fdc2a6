"""Rounds of joins against the walk in order that they stand for."""

import random

from pyspark.sql import functions as F

from atrium.plans import annotation, greedy


def test_first_kept_equals_the_walk_in_order(spark):
    rng = random.Random(3)
    near = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)), reverse=True)) for _ in range(90)} | {(i, i - 1) for i in range(20, 40)})
    near = [(i, j) for i, j in near if i != j]
    kept: set[int] = set()
    for i in range(60):
        if not any(j in kept for k, j in near if k == i):
            kept.add(i)
    got = {r.id: r.kept for r in greedy.first_kept(spark.range(60), spark.createDataFrame(near, "id long, earlier long")).collect()}
    assert got == {i: i in kept for i in range(60)}
    assert greedy.first_kept(spark.range(0), spark.createDataFrame([], "id long, earlier long")).count() == 0


def test_matches_are_those_taken_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    boxes = {r.area_id: r for r in annotation.derived(spark, sf, "area").collect()}
    other = {r.area_id: r for r in annotation._reference(annotation.derived(spark, sf, "area")).collect()}

    def iou(a, b):
        w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
        size = lambda r: (r.x1 - r.x0) * (r.y1 - r.y0)
        return w * h / (size(a) + size(b) - w * h) if w > 0 and h > 0 and a.floor_id == b.floor_id else 0

    pairs = sorted(((round(iou(a, b), 9), i, j) for i, a in boxes.items() for j, b in other.items() if iou(a, b) >= 0.5), reverse=True)
    mine, theirs, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in mine and j not in theirs:
            mine.add(i), theirs.add(j), want.add((i, j))
    assert {(r.area_id, r.other_id) for r in annotation.detection_matches(spark, sf).select("area_id", "other_id").collect()} == want and want


def test_cover_picks_the_place_that_gains_most(spark):
    picks = greedy.area_cover(spark, "/root/testdata/sf0.001", additions=2).orderBy("pick").collect()
    assert [p.pick for p in picks] == [1, 2] and picks[0].gain >= picks[1].gain > 0
    places = greedy.perimeter_candidates(spark, "/root/testdata/sf0.001")
    assert places.where(F.col("x").isin([p.x for p in picks])).count() >= 2
