"""Graphs from drawn paths, and outlines of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import overlay, paths, rings
from atrium.plans import coverage
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import step


def path_points(spark, d) -> DataFrame:
    """Places along the drawn paths: their ends, where they cross or touch, and every 2.5 m between; is more than one path there?"""
    lines = step(paths.segments(derived(spark, d, "walk_path")), "segments")
    out = paths.with_junctions(paths.points_along(lines), lines)
    return out.select("floor_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "junction").distinct()


def path_graph(spark, d) -> DataFrame:
    """The edges of the graph that the drawn paths make, with both ends' places and kinds."""
    nodes, edges = paths.graph_of_paths(derived(spark, d, "walk_path"))
    end = lambda k, p: nodes.select(F.col("node_id").alias(k), F.round("x", 4).alias(f"{p}x"), F.round("y", 4).alias(f"{p}y"), F.col("node_type").alias(f"{p}_type"))
    out = edges.join(end("source", "a"), "source").join(end("target", "b"), "target")
    return out.select("floor_id", "ax", "ay", "a_type", "bx", "by", "b_type", F.round("distance", 4).alias("distance"))


def _dead(spark, d) -> DataFrame:
    return step(coverage.counted(spark, d).where("n = 0").select("floor_id", "col", "row_no"), "dead")


def dead_zone_outlines(spark, d) -> DataFrame:
    """Outlines of the uncovered ground and of the holes in it, one row per ring: first corner, length and signed area in cells, corners."""
    around = step(rings.link(rings.mask_sides(_dead(spark, d))), "rings")
    size = around.groupBy("floor_id", "ring").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("y", "x")).alias("first"))
    corners = rings.turning_only(around).groupBy("ring").agg(F.count(F.lit(1)).alias("corners"))
    out = size.join(rings.areas(around).drop("floor_id"), "ring").join(corners, "ring")
    return out.select("floor_id", F.col("first.x").cast("long").alias("col"), F.col("first.y").cast("long").alias("row_no"), "length", F.col("area").cast("long").alias("area"), "corners")


def dead_zone_holes(spark, d) -> DataFrame:
    """Outlines of the uncovered ground with the number of holes in each and the area that is left, in cells."""
    around = step(rings.turning_only(rings.link(rings.mask_sides(_dead(spark, d)))), "rings")
    held = overlay.nested(around).groupBy("floor_id", "outline").agg((F.count(F.lit(1)) - 1).alias("holes"), F.sum("area").cast("long").alias("area"))
    return held.select("floor_id", "holes", "area")


POINT_SQL = """
turned AS (SELECT floor_id, path_id, i, CASE WHEN rotation = 0 THEN x ELSE mx + (x - mx) * cos(radians(rotation)) - (y - my) * sin(radians(rotation)) END AS x, CASE WHEN rotation = 0 THEN y ELSE my + (x - mx) * sin(radians(rotation)) + (y - my) * cos(radians(rotation)) END AS y
           FROM (SELECT *, (min(x) OVER p + max(x) OVER p) / 2 AS mx, (min(y) OVER p + max(y) OVER p) / 2 AS my FROM walk_path WINDOW p AS (PARTITION BY floor_id, path_id))),
seg AS (SELECT * FROM (SELECT floor_id, path_id * 10 + i AS s, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM turned WINDOW w AS (PARTITION BY floor_id, path_id ORDER BY i)) WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_)),
two AS (SELECT e.*, f.s AS o, f.ax AS cx, f.ay AS cy, f.bx AS dx, f.by_ AS dy, (e.bx-e.ax)*(f.by_-f.ay)-(e.by_-e.ay)*(f.bx-f.ax) AS den FROM seg e JOIN seg f ON e.floor_id = f.floor_id AND e.s < f.s),
tu AS (SELECT *, CASE WHEN abs(den) >= 1e-9 THEN ((cx-ax)*(dy-cy)-(cy-ay)*(dx-cx)) / den END AS t, CASE WHEN abs(den) >= 1e-9 THEN ((cx-ax)*(by_-ay)-(cy-ay)*(bx-ax)) / den END AS u FROM two),
hit AS (SELECT *, coalesce(t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9, false) AS x FROM tu),
cut AS (SELECT s, ax AS x, ay AS y FROM seg UNION ALL SELECT s, bx, by_ FROM seg
        UNION ALL SELECT unnest([s, o]), ax + t * (bx - ax), ay + t * (by_ - ay) FROM hit WHERE x
        UNION ALL SELECT who, px, py FROM (SELECT unnest([struct_pack(who := o, px := ax, py := ay, qx := cx, qy := cy, rx := dx, ry := dy), struct_pack(who := o, px := bx, py := by_, qx := cx, qy := cy, rx := dx, ry := dy),
            struct_pack(who := s, px := cx, py := cy, qx := ax, qy := ay, rx := bx, ry := by_), struct_pack(who := s, px := dx, py := dy, qx := ax, qy := ay, rx := bx, ry := by_)], recursive := true) FROM hit WHERE NOT x)
          WHERE abs((py - qy) * (rx - qx) - (px - qx) * (ry - qy)) < 1e-5 AND px BETWEEN least(qx, rx) - 1e-5 AND greatest(qx, rx) + 1e-5 AND py BETWEEN least(qy, ry) - 1e-5 AND greatest(qy, ry) + 1e-5),
stop AS (SELECT s, p.x AS x, p.y AS y FROM (SELECT s, min(struct_pack(x := x, y := y)) AS p FROM cut GROUP BY s, round(x, 6), round(y, 6))),
leg AS (SELECT g.floor_id, k.s, k.x, k.y, lead(k.x) OVER w AS nx, lead(k.y) OVER w AS ny FROM stop k JOIN seg g USING (s) WINDOW w AS (PARTITION BY k.s ORDER BY sqrt((g.ax-k.x)*(g.ax-k.x)+(g.ay-k.y)*(g.ay-k.y)), k.x, k.y)),
spot AS (SELECT DISTINCT floor_id, x, y FROM leg
         UNION SELECT floor_id, x + (nx - x) * (j * 2.5::double / l), y + (ny - y) * (j * 2.5::double / l) FROM (SELECT *, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS l FROM leg WHERE nx IS NOT NULL), unnest(range(1, CAST(floor(l / 2.5) AS bigint) + 1)) r(j) WHERE j * 2.5::double / l < 1),
spots AS (SELECT p.floor_id, p.x, p.y, count(*) > 1 AS junction FROM spot p JOIN seg g ON g.floor_id = p.floor_id AND abs((p.y - ay) * (bx - ax) - (p.x - ax) * (by_ - ay)) < 1e-5 AND p.x BETWEEN least(ax, bx) - 1e-5 AND greatest(ax, bx) + 1e-5 AND p.y BETWEEN least(ay, by_) - 1e-5 AND greatest(ay, by_) + 1e-5 GROUP BY ALL)"""

OUTLINE_SQL = coverage.CELLS_SQL + """,
mask AS (SELECT floor_id, col, row_no FROM counted WHERE n = 0),
rim AS (SELECT m.floor_id, m.col, m.row_no, k.way, m.col + k.x AS ax, m.row_no + k.y AS ay, m.col + k.x2 AS bx, m.row_no + k.y2 AS by_
        FROM mask m, (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 1, 1, 1, 0), (2, 1, 1, 0, 1, 0, 1), (3, 0, 1, 0, 0, -1, 0)) k(way, x, y, x2, y2, dc, dr)
        WHERE NOT EXISTS (SELECT 1 FROM mask o WHERE o.floor_id = m.floor_id AND o.col = m.col + k.dc AND o.row_no = m.row_no + k.dr)),
named AS (SELECT *, row_number() OVER (ORDER BY floor_id, ay, ax, way) AS e FROM rim),
follow AS (SELECT a.e AS s, arg_min(b.e, (b.way - a.way + 7) % 4) AS t FROM named a JOIN named b ON b.floor_id = a.floor_id AND b.ax = a.bx AND b.ay = a.by_ WHERE (b.way - a.way + 4) % 4 <> 2 GROUP BY a.e),
lab(e, label) USING KEY (e) AS (
  SELECT e, e FROM named
  UNION SELECT f.t, min(r.label) FROM lab r JOIN follow f ON f.s = r.e JOIN recurring.lab o ON o.e = f.t WHERE r.label < o.label GROUP BY f.t),
turn AS (SELECT n.*, l.label, n.way <> p.way AS turns FROM named n JOIN lab l USING (e) JOIN follow f ON f.t = n.e JOIN named p ON p.e = f.s)"""

QUERIES = {
    "path_points": Query(path_points, with_sql("+" + POINT_SQL.lstrip() + " SELECT DISTINCT floor_id, round(x, 4) AS x, round(y, 4) AS y, junction FROM spots", "walk_path")),
    "path_graph": Query(path_graph),
    "dead_zone_outlines": Query(dead_zone_outlines, with_sql("+" + OUTLINE_SQL + """
        SELECT floor_id, min(struct_pack(y := ay, x := ax)).x AS col, min(struct_pack(y := ay, x := ax)).y AS row_no, count(*) AS length, CAST(sum(ax * by_ - bx * ay) // 2 AS bigint) AS area, count(*) FILTER (turns) AS corners
        FROM turn GROUP BY floor_id, label -- USING KEY""", *coverage.BASE)),
    "dead_zone_holes": Query(dead_zone_holes),
}
