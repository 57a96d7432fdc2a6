"""Areas and rings of united, cut and subtracted polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import overlay, spatial
from atrium.plans import coverage
from atrium.plans.query import Query
from atrium.sources.derive import with_sql
from atrium.sources.shared import step

#: Least area that two polygons share to be told, in square metres and as a part of the smaller one.
LEAST_SHARED, LEAST_PART = 0.1, 0.005
TAKEN = ("restricted", "nonWalkable")


def ground(spark, d) -> DataFrame:
    """Sides of all restricted and blocked areas (layer a) and of the walkable areas (layer b)."""
    sides = coverage.geometry(spark, d).sides.where(F.col("role").isin(*TAKEN, "walkable"))
    return sides.select("floor_id", F.when(F.col("role") == "walkable", "b").otherwise("a").alias("layer"), "polygon_id", "ring", *overlay.LINE)


FREE: overlay.Rule = lambda a, b: (b > 0) & (a == 0)


def overlay_areas(spark, d) -> DataFrame:
    """Per floor: what areas take up together, how much of it twice or more, and how much of the walkable ground they take and leave."""
    cut = step(overlay.arrangement(ground(spark, d)), "arrangement")
    parts = {"taken": lambda a, b: a > 0, "overlapped": overlay.OVERLAP, "blocked": overlay.INTERSECTION, "free": FREE, "together": overlay.UNION}
    out = cut.select("floor_id").distinct()
    for name, rule in parts.items():
        out = out.join(overlay.area(cut, rule, name), "floor_id", "left")
    return out.select("floor_id", *[F.round(F.coalesce(name, F.lit(0.0)), 4).alias(name) for name in parts])


def polygon_overlaps(spark, d) -> DataFrame:
    """Pairs of areas that share more than 0.1 square metres and more than 0.5 % of the smaller: exact, with holes."""
    c = F.col
    sides = step(ground(spark, d).where("layer = 'a'"), "areas")
    box = sides.groupBy("floor_id", "polygon_id").agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"))
    left = spatial.spread(box, c("x0"), c("y0"), c("x1"), c("y1"), 10.0)
    right = left.select(c("floor_id").alias("f"), c("polygon_id").alias("other_id"), *[c(k).alias(f"o{k}") for k in ("x0", "y0", "x1", "y1")], c("bx").alias("kx"), c("by").alias("ky"))
    met = (c("x0") < c("ox1")) & (c("ox0") < c("x1")) & (c("y0") < c("oy1")) & (c("oy0") < c("y1")) & (c("bx") == F.floor(F.greatest("x0", "ox0") / 10.0)) & (c("by") == F.floor(F.greatest("y0", "oy0") / 10.0))
    pairs = step(left.join(right, (c("floor_id") == c("f")) & (c("bx") == c("kx")) & (c("by") == c("ky")) & (c("polygon_id") < c("other_id")) & met).select(F.struct(c("polygon_id").alias("one"), c("other_id").alias("two")).alias("pair")), "pairs")
    layer = lambda k, name: pairs.select("pair", c(f"pair.{k}").alias("polygon_id")).join(sides.drop("floor_id", "layer"), "polygon_id").select(c("pair").alias("floor_id"), F.lit(name).alias("layer"), "polygon_id", "ring", *overlay.LINE)
    cut = step(overlay.arrangement(layer("one", "a").unionByName(layer("two", "b"))), "arrangement")
    out = overlay.area(cut, overlay.INTERSECTION, "common")
    for name, rule in (("size", lambda a, b: a > 0), ("other_size", lambda a, b: b > 0)):
        out = out.join(overlay.area(cut, rule, name), "floor_id")
    out = out.where(c("common") > F.greatest(F.lit(LEAST_SHARED), LEAST_PART * F.least("size", "other_size")))
    return out.select(c("floor_id.one").alias("polygon_id"), c("floor_id.two").alias("other_id"), F.round("common", 4).alias("common"))


def free_space_rings(spark, d) -> DataFrame:
    """The walkable ground that no area takes, as polygons: each outline with its number of holes, corners and area less the holes."""
    cut = overlay.arrangement(ground(spark, d))
    corners = step(overlay.polygons(cut, FREE), "corners")
    own = overlay.nested(corners)
    size = corners.groupBy("ring").agg(F.count(F.lit(1)).alias("corners"))
    out = own.join(size, "ring").groupBy("floor_id", "outline").agg((F.count(F.lit(1)) - 1).alias("holes"), F.sum("corners").alias("corners"), F.round(F.sum("area"), 4).alias("area"))
    return out.select("floor_id", "holes", "corners", "area")


def slab_sql(edges: str, sums: str) -> str:
    """CTEs for a CTE ``edges`` (g, layer, poly, ax, ay, bx, by_): the plane in slabs between all x of corners and crossings.

    In a slab no two edges cross, so sorted by height they bound trapezoids; running numbers of polygons tell what each
    lies in. ``sums``: aggregates over strips (g, w, y, y1, na, nb).
    """
    return f"""
cross_x AS (SELECT DISTINCT e.g, e.ax + t * (e.bx - e.ax) AS x FROM (
    SELECT e.*, ((f.ax-e.ax)*(f.by_-f.ay)-(f.ay-e.ay)*(f.bx-f.ax)) / ((e.bx-e.ax)*(f.by_-f.ay)-(e.by_-e.ay)*(f.bx-f.ax)) AS t,
           ((f.ax-e.ax)*(e.by_-e.ay)-(f.ay-e.ay)*(e.bx-e.ax)) / ((e.bx-e.ax)*(f.by_-f.ay)-(e.by_-e.ay)*(f.bx-f.ax)) AS u
    FROM {edges} e JOIN {edges} f ON f.g = e.g AND abs((e.bx-e.ax)*(f.by_-f.ay)-(e.by_-e.ay)*(f.bx-f.ax)) > 1e-9) e WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
xs AS (SELECT g, ax AS x FROM {edges} UNION SELECT g, x FROM cross_x),
slab AS (SELECT * FROM (SELECT g, x AS x0, lead(x) OVER (PARTITION BY g ORDER BY x) AS x1 FROM xs) WHERE x1 - x0 > 1e-10),
hit AS (SELECT s.g, s.x0, s.x1, e.layer, e.poly, ay + ((x0 + x1) / 2 - ax) / (bx - ax) * (by_ - ay) AS y FROM slab s JOIN {edges} e ON e.g = s.g AND least(ax, bx) < (x0 + x1) / 2 AND greatest(ax, bx) > (x0 + x1) / 2),
sign AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY g, x0, layer, poly ORDER BY y) % 2 = 1 THEN 1 ELSE -1 END AS way FROM hit),
strip AS (SELECT g, x1 - x0 AS w, y, lead(y) OVER h AS y1, sum(CASE WHEN layer = 'a' THEN way ELSE 0 END) OVER h AS na, sum(CASE WHEN layer = 'b' THEN way ELSE 0 END) OVER h AS nb
          FROM sign WINDOW h AS (PARTITION BY g, x0 ORDER BY y ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT g, {sums} FROM strip WHERE y1 IS NOT NULL GROUP BY g)"""


def _sum(cond: str) -> str:
    return f"coalesce(sum((y1 - y) * w) FILTER ({cond}), 0)"


SIDE_SQL = """
side AS (SELECT floor_id, CASE WHEN role = 'walkable' THEN 'b' ELSE 'a' END AS layer, polygon_id AS poly, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_
         FROM vertex WHERE role IN ('restricted', 'nonWalkable', 'walkable') WINDOW w AS (PARTITION BY floor_id, polygon_id, ring ORDER BY i))"""

QUERIES = {
    "overlay_areas": Query(overlay_areas, with_sql("+" + SIDE_SQL.lstrip() + ", part AS (SELECT floor_id AS g, * EXCLUDE (floor_id) FROM side)," + slab_sql("part", f"{_sum('na > 0')} AS taken, {_sum('na > 1')} AS overlapped, {_sum('na > 0 AND nb > 0')} AS blocked, {_sum('nb > 0 AND na = 0')} AS free, {_sum('na > 0 OR nb > 0')} AS together") + """
        SELECT g AS floor_id, round(taken, 4) AS taken, round(overlapped, 4) AS overlapped, round(blocked, 4) AS blocked, round(free, 4) AS free, round(together, 4) AS together FROM sums""", "vertex")),
    "polygon_overlaps": Query(polygon_overlaps, with_sql("+" + SIDE_SQL.lstrip() + """,
        box AS (SELECT floor_id, poly, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM side WHERE layer = 'a' GROUP BY floor_id, poly),
        pair AS (SELECT a.poly AS one, b.poly AS two FROM box a JOIN box b ON a.floor_id = b.floor_id AND a.poly < b.poly AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
        part AS (SELECT one || ':' || two AS g, 'a' AS layer, poly, ax, ay, bx, by_ FROM pair JOIN side ON poly = one UNION ALL SELECT one || ':' || two, 'b', poly, ax, ay, bx, by_ FROM pair JOIN side ON poly = two),"""
        + slab_sql("part", f"{_sum('na > 0 AND nb > 0')} AS common, {_sum('na > 0')} AS size, {_sum('nb > 0')} AS other_size") + """
        SELECT CAST(split_part(g, ':', 1) AS bigint) AS polygon_id, CAST(split_part(g, ':', 2) AS bigint) AS other_id, round(common, 4) AS common FROM sums WHERE common > greatest(0.1, 0.005 * least(size, other_size))""", "vertex")),
    "free_space_rings": Query(free_space_rings),
}
