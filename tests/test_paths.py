"""Graphs from drawn paths against a plain walk in order; outlines of masks against the cells."""

import math
import random

from pyspark.sql import functions as F

from atrium.operators import overlay, paths, rings

POINT = "floor_id long, path_id long, i int, x double, y double, rotation double"


def plain_graph(rows, spacing=2.5, snap=0.15):
    """Nodes [(floor, x, y, kind)] and edges {(i, j)}, made segment by segment."""
    by_path = {}
    for f, p, i, x, y, turn in sorted(rows):
        by_path.setdefault((f, p), []).append((x, y, turn))
    lines = []
    for (f, _), pts in sorted(by_path.items(), key=lambda x: x[0][1]):
        mx, my = ((min(q[k] for q in pts) + max(q[k] for q in pts)) / 2 for k in (0, 1))
        a = math.radians(pts[0][2])
        pts = [(x, y) if not a else (mx + (x - mx) * math.cos(a) - (y - my) * math.sin(a), my + (x - mx) * math.sin(a) + (y - my) * math.cos(a)) for x, y, _ in pts]
        lines += [(f, p, q) for p, q in zip(pts, pts[1:]) if p != q]

    def on(p, a, b):
        off = abs((p[1] - a[1]) * (b[0] - a[0]) - (p[0] - a[0]) * (b[1] - a[1]))
        return off < 1e-5 and all(min(a[k], b[k]) - 1e-5 <= p[k] <= max(a[k], b[k]) + 1e-5 for k in (0, 1))

    cuts = [[a, b] for _, a, b in lines]
    for i, (f, a, b) in enumerate(lines):
        for j in range(i + 1, len(lines)):
            g, c, d = lines[j]
            if f != g:
                continue
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            t = u = None
            if abs(den) >= 1e-9:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
            if t is not None and -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                cuts[i].append(p)
                cuts[j].append(p)
            else:
                cuts[j] += [p for p in (a, b) if on(p, c, d)]
                cuts[i] += [p for p in (c, d) if on(p, a, b)]
    nodes, edges = [], set()
    for (f, a, _), own in zip(lines, cuts, strict=True):
        unique = {}
        for p in own:
            key = tuple(round(v, 6) for v in p)
            unique[key] = min(p, unique.get(key, p))
        stops = sorted(unique.values(), key=lambda p: (math.dist(a, p), p))
        spots = []
        for p, q in zip(stops, stops[1:]):
            n, length = int(math.dist(p, q) // spacing), math.dist(p, q)
            spots += [p] + [(p[0] + (q[0] - p[0]) * k * spacing / length, p[1] + (q[1] - p[1]) * k * spacing / length) for k in range(1, n + 1) if k * spacing / length < 1]
        before = None
        for p in [*spots, stops[-1]]:
            near = [(round(math.dist(p, n[1:3]), 9), k) for k, n in enumerate(nodes) if n[0] == f and math.dist(p, n[1:3]) <= snap]
            if near:
                k = min(near)[1]
            else:
                k = len(nodes)
                nodes.append((f, *p, "Junction" if sum(g == f and on(p, c, d) for g, c, d in lines) > 1 else "Corridor"))
            if before is not None and before != k:
                edges.add((min(before, k), max(before, k)))
            before = k
    return nodes, edges


def drawn(rng, n):
    rows = []
    for p in range(n):
        x, y = rng.randrange(0, 30, 5), rng.randrange(0, 30, 5)
        pts = [(x, y), (rng.randrange(0, 30, 5), y), (rng.uniform(0, 30), rng.uniform(0, 30))]
        if p % 4 == 0:
            pts += [(pts[-1][0] + 0.1, pts[-1][1]), pts[0]]
        rows += [(p % 2, p, i, float(a), float(b), 20.0 if p % 5 == 1 else 0.0) for i, (a, b) in enumerate(pts)]
    return rows


def test_graph_equals_the_walk_in_order(spark):
    rows = [*drawn(random.Random(11), 14), (0, 90, 0, 1.0, 1.0, 0.0), (0, 90, 1, 1.0, 1.0, 0.0), (1, 91, 0, 5.0, 5.0, 0.0)]
    nodes, edges = paths.graph_of_paths(spark.createDataFrame(rows, POINT))
    want_nodes, want_edges = plain_graph(rows)
    key = lambda f, x, y: (f, round(x, 5) + 0.0, round(y, 5) + 0.0)
    got_nodes = nodes.collect()
    assert sorted((*key(r.floor_id, r.x, r.y), r.node_type) for r in got_nodes) == sorted((*key(*n[:3]), n[3]) for n in want_nodes)
    at = {r.node_id: key(r.floor_id, r.x, r.y) for r in got_nodes}
    got = {frozenset((at[r.source], at[r.target])) for r in edges.collect()}
    assert got == {frozenset((key(*want_nodes[a][:3]), key(*want_nodes[b][:3]))) for a, b in want_edges}


def test_outlines_of_masks_hold_exactly_the_cells(spark):
    rng = random.Random(6)
    masks = {0: {(c, r) for c in range(12) for r in range(9) if rng.random() < 0.55}, 1: {(0, 0), (1, 1), (2, 0)}, 2: {(c, r) for c in range(5) for r in range(5)} - {(2, 2), (1, 1)} | {(8, 8)}}
    cells = spark.createDataFrame([(f, c, r) for f, m in masks.items() for c, r in m] + [(1, 0, 0)], "floor_id long, col long, row_no long")
    corners = rings.turning_only(rings.link(rings.mask_sides(cells))).cache()
    got = {}
    for r in corners.orderBy("floor_id", "ring", "seq").collect():
        got.setdefault((r.floor_id, r.ring), []).append((r.x, r.y))
    for f, mask in masks.items():
        own = [p for (g, _), p in got.items() if g == f]
        for c in range(-1, 13):
            for w in range(-1, 11):
                x, y, inside = c + 0.5, w + 0.5, 0
                for p in own:
                    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
                        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                            inside += 1 if by > ay else -1
                assert inside == ((c, w) in mask)
    held = {(r.floor_id, r.ring): r for r in overlay.nested(corners).collect()}
    assert sum(r.area for r in held.values()) == sum(map(len, masks.values()))
    assert sorted(r.area for (f, _), r in held.items() if f == 1) == [1.0, 1.0, 1.0]
    # Two holes that touch in a point are rings of their own, both in the outline around them.
    assert sorted(r.area for (f, _), r in held.items() if f == 2) == [-2.0, 1.0, 25.0] or sorted(r.area for (f, _), r in held.items() if f == 2) == [-1.0, -1.0, 1.0, 25.0]
    assert corners.where("floor_id = 1").groupBy("ring").agg(F.count("*").alias("n")).where("n <> 4").count() == 0
