"""Thinning and the graph of middle lines against plain versions."""

import math
import random

from atrium.operators import skeleton

AROUND = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def masks():
    rng = random.Random(6)
    yield {(x, y) for x in range(12) for y in range(9)}, 12, 9
    yield {(x, y) for x in range(2, 7) for y in range(2, 7)}, 9, 9
    yield {(x, 5) for x in range(3)}, 8, 8
    yield {(4, 4)}, 8, 8
    yield {(x, y) for x in range(1, 19) for y in range(1, 14) if not (5 <= x <= 9 and 4 <= y <= 8)}, 20, 15
    for k in range(4):
        w, h = 18, 14
        cells = set()
        for _ in range(7):
            x, y = rng.randrange(w - 3), rng.randrange(h - 3)
            dx, dy = rng.choice(((9, 3), (3, 8), (4, 4), (1, 7)))
            cells |= {(i, j) for i in range(x, min(w, x + dx)) for j in range(y, min(h, y + dy))}
        yield cells - {(rng.randrange(w), rng.randrange(h)) for _ in range(5 * k)}, w, h


def plain_thin(cells, w, h):
    left = set(cells)
    while True:
        changed = False
        for turn in (0, 1):
            off = set()
            for x, y in left:
                if not (0 < x < w - 1 and 0 < y < h - 1):
                    continue
                p = [(x + a, y + b) in left for a, b in AROUND]
                n, e, s, o = p[0], p[2], p[4], p[6]
                open_ = not (n and e and s) and not (e and s and o) if turn == 0 else not (n and e and o) and not (n and s and o)
                if 2 <= sum(p) <= 6 and sum(not p[j] and p[j - 7] for j in range(8)) == 1 and open_:
                    off.add((x, y))
            left -= off
            changed |= bool(off)
        if not changed:
            return left


def plain_graph(cells, w, h):
    left = plain_thin(cells, w, h)
    near = {c: set() for c in left}
    for x, y in left:
        for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
            to = (x + dx, y + dy)
            beside = {(x + dx, y), (x, y + 1)}
            if to in left and (not (dx and dy) or (beside <= cells and not beside & left)):
                near[x, y].add(to)
                near[to].add((x, y))
    if not any(near.values()):
        runs = []
        for y in range(h):
            x = 0
            while x < w:
                start = x
                while (x, y) in cells:
                    x += 1
                if x - start > 1:
                    runs.append((start - x, abs(y - h / 2), y, start, x - 1))
                x += x == start
        return {frozenset({(r[3], r[2]), (r[4], r[2])}) for r in [min(runs)]} if runs else set()
    for c in sorted(near):
        if len(near[c]) == 2:
            a, b = near[c]
            if (c[0] - a[0]) * (b[1] - c[1]) == (c[1] - a[1]) * (b[0] - c[0]):
                near[a] = near[a] - {c} | {b}
                near[b] = near[b] - {c} | {a}
                del near[c]
    return {frozenset({a, b}) for a in near for b in near[a]}


def test_masks_are_thinned_and_linked_as_by_the_plain_walk(spark):
    all_masks = list(masks())
    rows = [(k, x, y, "x") for k, (cells, _, _) in enumerate(all_masks) for x, y in cells]
    table = spark.createDataFrame(rows + rows[:50] + [(0, None, 1, "n"), (None, 1, 1, "n")], "floor_id long, col long, row_no long, note string")
    sizes = spark.createDataFrame([(k, w, h) for k, (_, w, h) in enumerate(all_masks)] + [(99, 5, 5)], "floor_id long, width long, height long")
    got = {}
    for r in skeleton.thinned(table, sizes).collect():
        got.setdefault(r.floor_id, set()).add((r.col, r.row_no))
    edges, lengths = {}, True
    for r in skeleton.graph_of_mask(table, sizes).collect():
        edges.setdefault(r.floor_id, set()).add(frozenset({(r.ac, r.ar), (r.bc, r.br)}))
        lengths &= math.isclose(r.length, math.hypot(r.ac - r.bc, r.ar - r.br))
    assert lengths
    for k, m in enumerate(all_masks):
        assert got[k] == plain_thin(*m), k
        assert edges.get(k, set()) == plain_graph(*m), k


def test_no_cells(spark):
    none = spark.createDataFrame([], "floor_id long, col long, row_no long")
    sizes = spark.createDataFrame([], "floor_id long, width long, height long")
    assert skeleton.graph_of_mask(none, sizes).count() == 0
