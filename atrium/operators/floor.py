"""Floor geometry: point conflicts, valid parts of segments and lines of sight, as joins on grid bins.

``Geometry`` holds polygons as rows of ring edges and walls and paths as capsules
(a segment with a width). Everything else follows from two equi-joins on
(floor, bin): points meet the polygons and capsules of their bin, segments meet
the ring edges and capsules of the bins they touch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import spatial
from atrium.sources.shared import step

BIN = 10.0
#: Part of a segment that must be valid for a free line of sight.
SEEN = 1 - 1e-7


@dataclass(frozen=True)
class Geometry:
    """``polygons``: floor_id, polygon_id, role, edges array<struct<ring,ax,ay,bx,by>>, holes, x0..y1; ``sides``: one row per ring
    edge (floor_id, ring_edge, cx, cy, dx, dy); ``capsules``: floor_id, path_id, seg, kind, width, cx, cy, dx, dy."""

    polygons: DataFrame
    sides: DataFrame
    capsules: DataFrame


def of_rings(vertices: DataFrame, capsules: DataFrame) -> Geometry:
    """From vertices (floor_id, polygon_id, role, ring, i, x, y) and capsules (floor_id, path_id, seg, kind, width, ax, ay, bx, by_).

    Ring 0 is the outline, others are holes; rings close by themselves. The three tables are written once and read again.
    """
    w = Window.partitionBy("floor_id", "polygon_id", "ring").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    sides = vertices.select("floor_id", "polygon_id", "role", "ring", "i", F.col("x").alias("cx"), F.col("y").alias("cy"), nxt("x").alias("dx"), nxt("y").alias("dy"))
    edge = F.struct("ring", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    sides = step(sides, "sides")
    polygons = sides.groupBy("floor_id", "polygon_id", "role").agg(F.collect_list(edge).alias("edges"), F.max("ring").alias("holes"), F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"))
    caps = capsules.select("floor_id", "path_id", "seg", "kind", "width", F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by_").alias("dy"))
    return Geometry(step(polygons, "polygons"), sides, step(caps, "capsules"))


def in_polygon(px: Column, py: Column, edges: Column, holes: Column) -> Column:
    """Is a point in a polygon given by its ring edges and its number of holes? Its outline and its holes' rings count as inside."""
    crosses = lambda e: (e["ay"] > py) != (e["by"] > py)
    left = lambda e: px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.when(e["by"] == e["ay"], 1.0).otherwise(e["by"] - e["ay"]) + e["ax"]
    odd = lambda ring: F.size(F.filter(edges, lambda e: (e["ring"] == ring) & crosses(e) & left(e))) % 2 == 1
    on = lambda ring: F.exists(edges, lambda e: (e["ring"] == ring) & (G.segment_distance(px, py, e["ax"], e["ay"], e["bx"], e["by"]) < G.EPS))
    in_hole = F.exists(F.sequence(F.lit(1), F.greatest(holes, F.lit(1))), lambda r: odd(r) & ~on(r))
    # In this order most points need one pass over the edges.
    return (odd(0) & ((holes == 0) | ~in_hole)) | on(0)


def _near(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points with the shapes of their bin; the shapes' columns floor_id, bx and by are gone."""
    placed = points.withColumn("bx", F.floor(F.col("x") / BIN).cast("int")).withColumn("by", F.floor(F.col("y") / BIN).cast("int"))
    shapes = shapes.withColumnsRenamed({"floor_id": "__f", "bx": "__bx", "by": "__by"})
    return placed.join(shapes, (F.col("floor_id") == F.col("__f")) & (F.col("bx") == F.col("__bx")) & (F.col("by") == F.col("__by")))


def _by_bin(geometry: Geometry) -> DataFrame:
    """(__f, __bx, __by, areas, paths): the polygons and the capsules of each bin."""
    c = F.col
    at = lambda df: df.withColumnsRenamed({"floor_id": "__f", "bx": "__bx", "by": "__by"})
    polygons = at(spatial.spread(geometry.polygons, c("x0") - G.EPS, c("y0") - G.EPS, c("x1") + G.EPS, c("y1") + G.EPS, BIN))
    half = c("width") / 2 + G.EPS
    caps = at(spatial.spread(geometry.capsules.withColumn("half", half), F.least("cx", "dx") - half, F.least("cy", "dy") - half, F.greatest("cx", "dx") + half, F.greatest("cy", "dy") + half, BIN))
    area, path = F.struct("role", "edges", "holes", "x0", "y0", "x1", "y1").alias("area"), F.struct("kind", "half", "cx", "cy", "dx", "dy").alias("path")
    bins = polygons.select("__f", "__bx", "__by", area).unionByName(caps.select("__f", "__bx", "__by", path), allowMissingColumns=True)
    return bins.groupBy("__f", "__bx", "__by").agg(F.collect_list("area").alias("areas"), F.collect_list("path").alias("paths"))


def conflicts(points: DataFrame, key: list[str], geometry: Geometry) -> DataFrame:
    """Adds ``conflict`` and ``conflict_off_path`` (walkability not asked for) to points (key, floor_id, x, y); null where there is none.

    The first that holds of: missing-building-boundary, outside-building, inside-wall, restricted-area,
    non-walkable-area, and, where walkability is asked for, missing-walkable-geometry, non-walkable-area.
    A point goes once to the shapes of its bin and finds all that it is in there.
    """
    c = F.col
    has = geometry.polygons.select("floor_id", "role").unionByName(geometry.capsules.select("floor_id", F.col("kind").alias("role")))
    has = has.groupBy("floor_id").agg(F.max(F.col("role") == "boundary").alias("has_boundary"), F.max(F.col("role").isin("walkable", "path")).alias("has_walkable"))
    placed = points.withColumn("__px", F.floor(c("x") / BIN).cast("int")).withColumn("__py", F.floor(c("y") / BIN).cast("int"))
    out = placed.join(_by_bin(geometry).hint("merge"), (c("floor_id") == c("__f")) & (c("__px") == c("__bx")) & (c("__py") == c("__by")), "left").join(has, "floor_id", "left")
    inside = lambda a: G.in_box(c("x"), c("y"), a["x0"], a["y0"], a["x1"], a["y1"]) & in_polygon(c("x"), c("y"), a["edges"], a["holes"])
    area = lambda k: F.coalesce(F.exists("areas", lambda a: (a["role"] == k) & inside(a)), F.lit(False))
    path = lambda k: F.coalesce(F.exists("paths", lambda p: (p["kind"] == k) & (G.segment_distance(c("x"), c("y"), p["cx"], p["cy"], p["dx"], p["dy"]) <= p["half"])), F.lit(False))
    yes = lambda k: F.coalesce(F.col(k), F.lit(False))
    first = F.when(~yes("has_boundary"), "missing-building-boundary").when(~area("boundary"), "outside-building").when(path("wall"), "inside-wall").when(area("restricted"), "restricted-area").when(area("nonWalkable"), "non-walkable-area")
    out = out.withColumn("conflict_off_path", first)
    full = F.coalesce("conflict_off_path", F.when(~yes("has_walkable"), "missing-walkable-geometry").when(~(area("walkable") | path("path")), "non-walkable-area"))
    return out.select(*points.columns, full.alias("conflict"), "conflict_off_path")


def line_cuts(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """array of places (0..1 on a-b) where segment c-d cuts a-b; both ends of a shared stretch where they lie on one line."""
    rx, ry, sx, sy, ex, ey = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    den = rx * sy - ry * sx
    safe = F.when(F.abs(den) > G.EPS, den).otherwise(1.0)
    t, u = (ex * sy - ey * sx) / safe, (ex * ry - ey * rx) / safe
    meet = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    same = F.abs(ex * ry - ey * rx) < G.EPS
    ends = F.array(G.along(cx, cy, ax, ay, bx, by), G.along(dx, dy, ax, ay, bx, by))
    none = F.array().cast("array<double>")
    return F.when(F.abs(den) > G.EPS, F.when(meet, F.array(t)).otherwise(none)).when(same, ends).otherwise(none)


def circle_cuts(ax, ay, bx, by, cx, cy, r) -> Column:
    """array of places (0..1 on a-b) on a circle."""
    dx, dy, ex, ey = bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = dx * dx + dy * dy, 2 * (ex * dx + ey * dy), ex * ex + ey * ey - r * r
    root = b * b - 4 * a * c
    s = F.sqrt(F.greatest(root, F.lit(0.0)))
    den = F.when(a > 0, 2 * a).otherwise(1.0)
    both = F.filter(F.array((-b - s) / den, (-b + s) / den), lambda t: (t >= 0) & (t <= 1))
    return F.when((a > 0) & (root >= 0), both).otherwise(F.array().cast("array<double>"))


def _meeting(segments: DataFrame, shapes: DataFrame, margin) -> DataFrame:
    """Segments with the straight shapes (cx, cy, dx, dy) whose boxes meet theirs; a pair comes from one bin only."""
    c = F.col
    boxed = segments.withColumns({"sx0": F.least("ax", "bx"), "sy0": F.least("ay", "by"), "sx1": F.greatest("ax", "bx"), "sy1": F.greatest("ay", "by")}).withColumnsRenamed({"bx": "ex", "by": "ey"})
    lines = spatial.spread(boxed, c("sx0"), c("sy0"), c("sx1"), c("sy1"), BIN)
    m = margin + G.EPS
    shapes = shapes.withColumns({"tx0": F.least("cx", "dx") - m, "ty0": F.least("cy", "dy") - m, "tx1": F.greatest("cx", "dx") + m, "ty1": F.greatest("cy", "dy") + m})
    shapes = spatial.spread(shapes, c("tx0"), c("ty0"), c("tx1"), c("ty1"), BIN).withColumnsRenamed({"floor_id": "__f", "bx": "__bx", "by": "__by"})
    same = (c("floor_id") == c("__f")) & (c("bx") == c("__bx")) & (c("by") == c("__by"))
    met = (c("sx0") <= c("tx1")) & (c("tx0") <= c("sx1")) & (c("sy0") <= c("ty1")) & (c("ty0") <= c("sy1"))
    first = (c("bx") == F.floor(F.greatest("sx0", "tx0") / BIN)) & (c("by") == F.floor(F.greatest("sy0", "ty0") / BIN))
    return lines.join(shapes, same & met & first)


def _outlines(geometry: Geometry) -> tuple[DataFrame, DataFrame]:
    """What bounds the shapes: straight lines (floor_id, cx, cy, dx, dy), of rings and of both sides of capsules, and circles (floor_id, cx, cy, dx, dy, r), a point each."""
    c, caps = F.col, geometry.capsules
    r, length = c("width") / 2, G.distance(c("cx"), c("cy"), c("dx"), c("dy"))
    nx, ny = -(c("dy") - c("cy")) * r / c("length"), (c("dx") - c("cx")) * r / c("length")
    long = caps.withColumn("length", length).where("length > 0").select("floor_id", "cx", "cy", "dx", "dy", nx.alias("nx"), ny.alias("ny"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("k"))
    off = lambda at, n: (c(at) + c("k") * c(n)).alias(at)
    sides = long.select("floor_id", off("cx", "nx"), off("cy", "ny"), off("dx", "nx"), off("dy", "ny"))
    straight = geometry.sides.select("floor_id", "cx", "cy", "dx", "dy").unionByName(sides)
    end = F.explode(F.array(F.struct(c("cx").alias("x"), c("cy").alias("y")), F.struct(c("dx").alias("x"), c("dy").alias("y"))))
    ends = caps.select("floor_id", r.alias("r"), end.alias("e")).distinct()
    return straight, ends.select("floor_id", c("e.x").alias("cx"), c("e.y").alias("cy"), c("e.x").alias("dx"), c("e.y").alias("dy"), "r")


def cuts(segments: DataFrame, key: list[str], geometry: Geometry) -> DataFrame:
    """(key, t): where a segment's line crosses a ring or the edge of a capsule.

    Capsules are taken apart into lines and circles before they meet segments, so a pair is one short formula.
    """
    a, b, c, d = (("ax", "ay"), ("ex", "ey"), ("cx", "cy"), ("dx", "dy"))
    at = [F.col(k) for p in (a, b, c, d) for k in p]
    straight, circles = _outlines(geometry)
    lines = _meeting(segments, straight, F.lit(0.0)).select(*key, F.explode(line_cuts(*at)).alias("t"))
    rounds = _meeting(segments, circles, F.col("r")).select(*key, F.explode(circle_cuts(*at[:6], F.col("r"))).alias("t"))
    return lines.unionByName(rounds)


def valid_intervals(segments: DataFrame, key: list[str], geometry: Geometry, walkable: bool = True, found: DataFrame | None = None) -> DataFrame:
    """(key, lo, hi): the parts of segments (key, floor_id, ax, ay, bx, by) on which no point has a conflict.

    Segments are cut at all rings and capsules, and the middle of each piece tells
    for the whole piece, so no wall is too thin to be seen. Pieces that touch are joined.
    ``found`` may give the cuts.
    """
    found = cuts(segments, key, geometry) if found is None else found
    ends = segments.select(*key, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    w = Window.partitionBy(*key).orderBy("t")
    kept = found.unionByName(ends).distinct().withColumn("before", F.lag("t").over(w)).where("before is null or t - before > 1e-8").drop("before")
    pieces = kept.withColumn("hi", F.lead("t").over(w)).where("hi - t > 1e-8").withColumnRenamed("t", "lo").join(segments.hint("merge"), key)
    mid = (F.col("lo") + F.col("hi")) / 2
    at = pieces.select(*key, "floor_id", "lo", "hi", (F.col("ax") + mid * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + mid * (F.col("by") - F.col("ay"))).alias("y"))
    free = conflicts(at, [*key, "lo"], geometry).where(f"{'conflict' if walkable else 'conflict_off_path'} is null").select(*key, "lo", "hi")
    return spatial.interval_union(free, key)


def blocking(geometry: Geometry) -> Geometry:
    """The shapes that can take sight: walkable areas and paths never do."""
    return Geometry(geometry.polygons.where("role <> 'walkable'"), geometry.sides.where("role <> 'walkable'"), geometry.capsules.where("kind <> 'path'"))


def _comes_near(shape: Column) -> Column:
    """May line a-b touch a shape (cx, cy, dx, dy, m), m its half width and a margin? Never false where it does."""
    c, m = F.col, shape["m"]
    box = (F.least("ax", "bx") <= F.greatest(shape["cx"], shape["dx"]) + m) & (F.greatest("ax", "bx") >= F.least(shape["cx"], shape["dx"]) - m)
    box &= (F.least("ay", "by") <= F.greatest(shape["cy"], shape["dy"]) + m) & (F.greatest("ay", "by") >= F.least(shape["cy"], shape["dy"]) - m)
    side = lambda px, py: (c("bx") - c("ax")) * (py - c("ay")) - (c("by") - c("ay")) * (px - c("ax"))
    p, q, reach = side(shape["cx"], shape["cy"]), side(shape["dx"], shape["dy"]), m * G.distance(c("ax"), c("ay"), c("bx"), c("by"))
    return box & (F.greatest(p, q) >= -reach) & (F.least(p, q) <= reach)


def around(hubs: DataFrame, x: str, y: str, reach: Column, geometry: Geometry) -> DataFrame:
    """Adds ``__shapes`` to hubs (floor_id, x, y): the straight shapes that may take sight in the square of ``reach`` around each."""
    c, geometry, place = F.col, blocking(geometry), ["floor_id", x, y, "reach"]
    hubs = hubs.withColumn("reach", reach)
    boxed = hubs.select("floor_id", c(x).alias("hx"), c(y).alias("hy"), "reach").distinct().withColumns({"sx0": c("hx") - c("reach"), "sy0": c("hy") - c("reach"), "sx1": c("hx") + c("reach"), "sy1": c("hy") + c("reach")})
    boxed = spatial.spread(boxed, c("sx0"), c("sy0"), c("sx1"), c("sy1"), BIN)
    lines = ["cx", "cy", "dx", "dy"]
    shapes = geometry.sides.select("floor_id", *lines, F.lit(1e-6).alias("m")).unionByName(geometry.capsules.select("floor_id", *lines, (c("width") / 2 + 1e-6).alias("m")))
    shapes = shapes.withColumns({"tx0": F.least("cx", "dx") - c("m"), "ty0": F.least("cy", "dy") - c("m"), "tx1": F.greatest("cx", "dx") + c("m"), "ty1": F.greatest("cy", "dy") + c("m")})
    shapes = spatial.spread(shapes, c("tx0"), c("ty0"), c("tx1"), c("ty1"), BIN).withColumnsRenamed({"floor_id": "__f", "bx": "__bx", "by": "__by"})
    met = (c("sx0") <= c("tx1")) & (c("tx0") <= c("sx1")) & (c("sy0") <= c("ty1")) & (c("ty0") <= c("sy1"))
    first = (c("bx") == F.floor(F.greatest("sx0", "tx0") / BIN)) & (c("by") == F.floor(F.greatest("sy0", "ty0") / BIN))
    near = boxed.join(shapes, (c("floor_id") == c("__f")) & (c("bx") == c("__bx")) & (c("by") == c("__by")) & met & first)
    near = near.groupBy("floor_id", "hx", "hy", "reach").agg(F.collect_list(F.struct(*lines, "m")).alias("__shapes")).withColumnsRenamed({"hx": x, "hy": y})
    return hubs.join(near.hint("merge"), place, "left").drop("reach")


def visible(pairs: DataFrame, key: list[str], geometry: Geometry, open_start: bool = False, hub: list[str] | None = None) -> DataFrame:
    """The pairs (key, floor_id, ax, ay, bx, by) with a free line of sight, in their own columns, others too.

    Only lines that meet a ring or a capsule are cut into parts; any other line is
    free if its start is. ``open_start`` tells that all starts are known to be.
    Where many lines share their end (bx, by), as the points around a beacon do, pairs may bring the shapes ``around`` it,
    gathered before points and beacons meet: lines that none of them comes near are settled there. ``hub`` names the key of
    the ends, to have them gathered here.
    """
    geometry = blocking(geometry)
    if hub:
        c = F.col
        ends = pairs.groupBy("floor_id", *hub).agg(F.first("bx").alias("hx"), F.first("by").alias("hy"), F.max(G.distance(c("ax"), c("ay"), c("bx"), c("by"))).alias("far"))
        pairs = pairs.join(around(ends, "hx", "hy", c("far"), geometry).select(*hub, "__shapes").hint("merge"), hub, "left")
    settled = "__shapes" in pairs.columns
    if settled:
        near = F.coalesce(F.exists("__shapes", _comes_near), F.lit(False)) | (F.col("ax").eqNullSafe(F.col("bx")) & F.col("ay").eqNullSafe(F.col("by")))
        pairs = step(pairs.withColumn("__near", near).drop("__shapes"), "lines")
        free, pairs = pairs.where("not __near").drop("__near"), pairs.where("__near").drop("__near")
    found = step(cuts(pairs, key, geometry), "cuts")
    meeting = found.select(*key).distinct().hint("merge")
    clear = pairs.join(meeting, key, "left_anti")
    clear = clear.unionByName(free) if settled else clear
    parts = valid_intervals(pairs.select(*key, "floor_id", "ax", "ay", "bx", "by").join(meeting, key, "left_semi"), key, geometry, False, found)
    seen = parts.groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("seen")).where(F.col("seen") >= SEEN).select(*key)
    if not open_start:
        starts = clear.select("floor_id", F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
        ok = conflicts(starts, ["floor_id", "x", "y"], geometry).where("conflict_off_path is null").select("floor_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
        clear = clear.join(ok.hint("merge"), ["floor_id", "ax", "ay"], "left_semi")
    # A pair whose two ends are one point has no length to measure.
    point = pairs.where("ax = bx and ay = by").select(*key, "floor_id", F.col("ax").alias("x"), F.col("ay").alias("y")).join(meeting, key, "left_semi")
    seen = seen.unionByName(conflicts(point, key, geometry).where("conflict_off_path is null").select(*key))
    return pairs.join(seen.hint("merge"), key, "left_semi").select(*clear.columns).unionByName(clear)


# The same, as SQL over the tables vertex and capsule; nothing is binned there.
_T = "greatest(0.0, least(1.0, ((p.x-s.cx)*(s.dx-s.cx)+(p.y-s.cy)*(s.dy-s.cy)) / (power(s.dx-s.cx, 2)+power(s.dy-s.cy, 2))))"
_DIST = f"sqrt(power(p.x-s.cx-{_T}*(s.dx-s.cx), 2)+power(p.y-s.cy-{_T}*(s.dy-s.cy), 2))"
SHAPES_SQL = """
side AS (SELECT floor_id, polygon_id, role, ring, i, x AS cx, y AS cy, coalesce(lead(x) OVER w, first_value(x) OVER w) AS dx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS dy
         FROM vertex WINDOW w AS (PARTITION BY floor_id, polygon_id, ring ORDER BY i)),
cap AS (SELECT floor_id, path_id, seg, kind, width, ax AS cx, ay AS cy, bx AS dx, by_ AS dy FROM capsule),
has AS (SELECT floor_id, bool_or(role = 'boundary') AS has_boundary, bool_or(role IN ('walkable', 'path')) AS has_walkable
        FROM (SELECT floor_id, role FROM vertex UNION ALL SELECT floor_id, kind FROM capsule) GROUP BY floor_id)"""


def conflict_sql(points: str, out: str) -> str:
    """CTEs that give ``out`` (pid, floor_id, x, y, conflict, conflict_off_path) for a CTE ``points`` (pid, floor_id, x, y)."""
    return f"""
{out}_ring AS (SELECT p.pid, s.polygon_id, s.role, s.ring, count(*) FILTER ((s.cy > p.y) <> (s.dy > p.y) AND p.x < (s.dx-s.cx)*(p.y-s.cy)/(s.dy-s.cy)+s.cx) % 2 = 1 AS odd, min({_DIST}) < 1e-8 AS edge
         FROM {points} p JOIN side s ON s.floor_id = p.floor_id GROUP BY ALL),
{out}_area AS (SELECT pid, role, (bool_or(ring = 0 AND edge) OR (bool_or(ring = 0 AND odd) AND NOT bool_or(ring > 0 AND odd AND NOT edge))) AS inside FROM {out}_ring GROUP BY pid, polygon_id, role),
{out}_met AS (SELECT pid, role AS met FROM {out}_area WHERE inside UNION SELECT p.pid, s.kind FROM {points} p JOIN cap s ON s.floor_id = p.floor_id AND {_DIST} <= s.width / 2 + 1e-8),
{out}_in AS (SELECT pid, list(met) AS m FROM {out}_met GROUP BY pid),
{out}_off AS (SELECT p.*, i.m, h.has_walkable, CASE WHEN NOT coalesce(h.has_boundary, false) THEN 'missing-building-boundary' WHEN NOT coalesce(list_contains(m, 'boundary'), false) THEN 'outside-building'
         WHEN list_contains(m, 'wall') THEN 'inside-wall' WHEN list_contains(m, 'restricted') THEN 'restricted-area' WHEN list_contains(m, 'nonWalkable') THEN 'non-walkable-area' END AS conflict_off_path
         FROM {points} p LEFT JOIN {out}_in i ON i.pid = p.pid LEFT JOIN has h ON h.floor_id = p.floor_id),
{out} AS (SELECT pid, floor_id, x, y, conflict_off_path, coalesce(conflict_off_path, CASE WHEN NOT coalesce(has_walkable, false) THEN 'missing-walkable-geometry'
         WHEN NOT (list_contains(m, 'walkable') OR list_contains(m, 'path')) THEN 'non-walkable-area' END) AS conflict FROM {out}_off)"""


def intervals_sql(segments: str, out: str, walkable: bool) -> str:
    """CTEs that give ``out`` (sid, lo, hi), not joined where they touch, for a CTE ``segments`` (sid, floor_id, ax, ay, bx, by_)."""
    return f"""
{out}_line AS (SELECT g.sid, g.ax, g.ay, g.bx, g.by_, s.cx, s.cy, s.dx, s.dy FROM {segments} g JOIN side s ON s.floor_id = g.floor_id
           AND greatest(g.ax, g.bx) >= least(s.cx, s.dx) - 1e-8 AND least(g.ax, g.bx) <= greatest(s.cx, s.dx) + 1e-8 AND greatest(g.ay, g.by_) >= least(s.cy, s.dy) - 1e-8 AND least(g.ay, g.by_) <= greatest(s.cy, s.dy) + 1e-8
           UNION ALL SELECT sid, ax, ay, bx, by_, cx + k * nx, cy + k * ny, dx + k * nx, dy + k * ny FROM (SELECT g.*, s.cx, s.cy, s.dx, s.dy, -(s.dy-s.cy)*s.width/2/sqrt(power(s.dx-s.cx,2)+power(s.dy-s.cy,2)) AS nx, (s.dx-s.cx)*s.width/2/sqrt(power(s.dx-s.cx,2)+power(s.dy-s.cy,2)) AS ny
             FROM {segments} g JOIN cap s ON s.floor_id = g.floor_id), (VALUES (-1), (1)) v(k)),
{out}_cross AS (SELECT *, (bx-ax)*(dy-cy)-(by_-ay)*(dx-cx) AS den, (cx-ax)*(dy-cy)-(cy-ay)*(dx-cx) AS tn, (cx-ax)*(by_-ay)-(cy-ay)*(bx-ax) AS un, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS l2 FROM {out}_line),
{out}_round AS (SELECT g.sid, (g.bx-g.ax)*(g.bx-g.ax)+(g.by_-g.ay)*(g.by_-g.ay) AS a, 2*((g.ax-e.x)*(g.bx-g.ax)+(g.ay-e.y)*(g.by_-g.ay)) AS b, power(g.ax-e.x,2)+power(g.ay-e.y,2)-e.width*e.width/4 AS c
           FROM {segments} g JOIN (SELECT floor_id, width, cx AS x, cy AS y FROM cap UNION ALL SELECT floor_id, width, dx, dy FROM cap) e ON e.floor_id = g.floor_id),
{out}_t AS (SELECT sid, 0.0::double AS t FROM {segments} UNION SELECT sid, 1.0::double FROM {segments}
           UNION SELECT sid, tn / den FROM {out}_cross WHERE abs(den) > 1e-8 AND tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1
           UNION SELECT sid, greatest(0.0, least(1.0, ((cx-ax)*(bx-ax)+(cy-ay)*(by_-ay)) / l2)) FROM {out}_cross WHERE abs(den) <= 1e-8 AND abs(un) < 1e-8 AND l2 > 0
           UNION SELECT sid, greatest(0.0, least(1.0, ((dx-ax)*(bx-ax)+(dy-ay)*(by_-ay)) / l2)) FROM {out}_cross WHERE abs(den) <= 1e-8 AND abs(un) < 1e-8 AND l2 > 0
           UNION SELECT sid, (-b-sqrt(b*b-4*a*c))/(2*a) FROM {out}_round WHERE a > 0 AND b*b-4*a*c >= 0 AND (-b-sqrt(b*b-4*a*c))/(2*a) BETWEEN 0 AND 1
           UNION SELECT sid, (-b+sqrt(b*b-4*a*c))/(2*a) FROM {out}_round WHERE a > 0 AND b*b-4*a*c >= 0 AND (-b+sqrt(b*b-4*a*c))/(2*a) BETWEEN 0 AND 1),
{out}_kept AS (SELECT sid, t FROM (SELECT *, lag(t) OVER (PARTITION BY sid ORDER BY t) AS before FROM {out}_t) WHERE before IS NULL OR t - before > 1e-8),
{out}_piece AS (SELECT sid, t AS lo, hi FROM (SELECT *, lead(t) OVER (PARTITION BY sid ORDER BY t) AS hi FROM {out}_kept) WHERE hi - t > 1e-8),
{out}_mid AS (SELECT sid::varchar || ':' || lo AS pid, q.sid, q.lo, q.hi, g.floor_id, g.ax + (lo+hi)/2*(g.bx-g.ax) AS x, g.ay + (lo+hi)/2*(g.by_-g.ay) AS y FROM {out}_piece q JOIN {segments} g USING (sid)),{conflict_sql(out + '_mid', out + '_c')},
{out} AS (SELECT m.sid, m.lo, m.hi FROM {out}_mid m JOIN {out}_c c USING (pid) WHERE c.{'conflict' if walkable else 'conflict_off_path'} IS NULL)"""
