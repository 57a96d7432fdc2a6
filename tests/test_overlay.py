"""Overlay of polygons and linking of rings against rasters, boxes and a plain sweep."""

import math
import random

from pyspark.sql import functions as F

from atrium.operators import overlay, rings

SIDE = "floor_id long, layer string, polygon_id long, ring int, cx double, cy double, dx double, dy double"


def sides(spark, shapes):
    """Of (floor_id, layer, polygon_id, [rings of points])."""
    rows = [(f, layer, p, r, *map(float, (*ring[i], *ring[(i + 1) % len(ring)]))) for f, layer, p, all_rings in shapes for r, ring in enumerate(all_rings) for i in range(len(ring))]
    return spark.createDataFrame(rows, SIDE)


def box(x0, y0, x1, y1, clockwise=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return ring[::-1] if clockwise else ring


def sweep(shapes, floor_id):
    """{rule: area} by slabs between all x of corners and crossings."""
    edges = [(layer, p, *ring[i], *ring[(i + 1) % len(ring)]) for f, layer, p, all_rings in shapes if f == floor_id for ring in all_rings for i in range(len(ring))]
    xs = {x for e in edges for x in (e[2], e[4])}
    for i, (_, _, ax, ay, bx, by) in enumerate(edges):
        for _, _, cx, cy, dx, dy in edges[:i]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if abs(den) > 1e-12:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(ax + t * (bx - ax))
    out = dict.fromkeys(("union", "both", "minus", "twice"), 0.0)
    xs = sorted(xs)
    for x0, x1 in zip(xs, xs[1:]):
        mid = (x0 + x1) / 2
        cuts = sorted((ay + (mid - ax) / (bx - ax) * (by - ay), layer, p) for layer, p, ax, ay, bx, by in edges if min(ax, bx) < mid < max(ax, bx))
        inside = set()
        for (y, layer, p), (y1, _, _) in zip(cuts, cuts[1:]):
            inside ^= {(layer, p)}
            a, b = (sum(k == n for k, _ in inside) for n in "ab")
            size = (y1 - y) * (x1 - x0)
            for name, holds in (("union", a or b), ("both", a and b), ("minus", a and not b), ("twice", a > 1)):
                out[name] += size * bool(holds)
    return out


RULES = {"union": overlay.UNION, "both": overlay.INTERSECTION, "minus": overlay.DIFFERENCE, "twice": overlay.OVERLAP}


def check(spark, shapes, tolerance=1e-6):
    cut = overlay.arrangement(sides(spark, shapes)).cache()
    for name, rule in RULES.items():
        got = {r.floor_id: r.area for r in overlay.area(cut, rule).collect()}
        for f in {s[0] for s in shapes}:
            assert abs(got.get(f, 0.0) - sweep(shapes, f)[name]) < tolerance, (name, f)
    return cut


def test_boxes_with_holes_that_share_sides_and_corners(spark):
    rng = random.Random(7)
    shapes = [(f, "a" if p % 3 else "b", f * 100 + p, [box(x, y, x + w, y + h, p % 2 == 0)] + ([box(x + 1, y + 1, x + w - 1, y + h - 1, p % 4 == 0)] if w > 2 and h > 2 and p % 2 else [])) for f in range(3) for p in range(14) for x, y, w, h in [(rng.randrange(24), rng.randrange(24), rng.randint(1, 9), rng.randint(1, 9))]]
    shapes.append((0, "a", 99, [box(3, 3, 6, 6)]))
    shapes.append((0, "a", 98, [box(3, 3, 6, 6)]))
    check(spark, shapes)


def test_stars_at_any_angle(spark):
    rng = random.Random(3)

    def star(x, y, n, shrink=1.0):
        return [(x + shrink * r * math.cos(a), y + shrink * r * math.sin(a)) for k in range(n) for a in [2 * math.pi * k / n] for r in [6 if k % 2 else 3.5]]

    shapes = []
    for f in range(2):
        for p in range(12):
            x, y, n = rng.uniform(0, 30), rng.uniform(0, 30), 2 * rng.randint(3, 6)
            shapes.append((f, "a" if p % 2 else "b", f * 100 + p, [star(x, y, n)] + ([star(x, y, n, 0.4)] if p % 3 == 0 else [])))
    cut = check(spark, shapes)
    for rule in (overlay.UNION, overlay.DIFFERENCE):
        corners = overlay.polygons(cut, rule).cache()
        got = {r.floor_id: r.a for r in rings.areas(corners).groupBy("floor_id").agg(F.sum("area").alias("a")).collect()}
        want = {r.floor_id: r.area for r in overlay.area(cut, rule).collect()}
        assert all(abs(got[f] - want[f]) < 1e-6 for f in want)
        held = overlay.nested(corners).collect()
        assert all((r.outline == r.ring) == (r.area > 0) and r.outline is not None for r in held)


def test_rings_touching_in_a_point_are_apart_and_holes_find_their_outline(spark):
    shapes = [
        (0, "a", 1, [box(0, 0, 2, 2)]), (0, "a", 2, [box(2, 2, 4, 4)]),
        (1, "a", 3, [box(0, 0, 20, 20)]), (1, "b", 4, [box(2, 2, 12, 12), box(4, 4, 10, 10)]), (1, "b", 6, [box(15, 15, 18, 18)]),
        (2, "a", 7, [box(0, 0, 5, 5)]), (2, "b", 8, [box(0, 0, 5, 5)]),
        (3, "a", 9, [box(0, 0, 4, 2)]), (3, "a", 10, [box(0, 2, 4, 4)]),
    ]
    cut = overlay.arrangement(sides(spark, shapes))
    corners = overlay.polygons(cut, overlay.DIFFERENCE).cache()
    sizes = sorted((r.floor_id, r.n) for r in corners.groupBy("floor_id", "ring").agg(F.count("*").alias("n")).collect())
    assert sizes == [(0, 4), (0, 4)] + [(1, 4)] * 4 + [(3, 4)]
    held = overlay.nested(corners).collect()
    areas = {r.ring: r.area for r in held}
    assert sorted((r.floor_id, r.area, areas[r.outline]) for r in held) == [(0, 4.0, 4.0), (0, 4.0, 4.0), (1, -100.0, 400.0), (1, -9.0, 400.0), (1, 36.0, 36.0), (1, 400.0, 400.0), (3, 16.0, 16.0)]


def test_cycles_of_any_length_are_ranked(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 1200)
    links, want, at = [], {}, 0
    for n in (1, 2, 3, 64, 65, 500, 565):
        ring = ids[at : at + n]
        at += n
        links += [(ring[i], ring[(i + 1) % n]) for i in range(n)]
        first = ring.index(min(ring))
        want |= {e: (min(ring), (i - first) % n, n) for i, e in enumerate(ring)}
    got = {r.edge: (r.ring, r.seq, r.length) for r in rings.ranked_cycles(spark.createDataFrame(links, "edge long, next long")).collect()}
    assert got == want


def test_overlay_of_nothing(spark):
    cut = overlay.arrangement(sides(spark, [(0, "a", 1, [[(1, 1), (1, 1)]])]))
    assert cut.count() == 0 and overlay.area(cut, overlay.UNION).count() == 0 and overlay.polygons(cut, overlay.UNION).count() == 0
