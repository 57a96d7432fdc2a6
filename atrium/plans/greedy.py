"""Placement steps that depend on order, as rounds of joins: merging, area cover; and their candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.operators.order import first_kept
from atrium.plans import coverage, network
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import step

# Metres between automatic beacons, along an outline, and from it; metres looked across an edge.
APART, SPACING, INSET, REACH = 3.0, 5.5, 0.4, 100.0
RADIUS = 8.0


def near_and_seen(points: DataFrame, apart: float, shapes: floor.Geometry) -> DataFrame:
    """Pairs (id, earlier) of points (id, floor_id, x, y) closer than ``apart`` and in sight of each other, earlier < id."""
    discs = points.select("floor_id", F.col("id").alias("earlier"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = spatial.disc_join(points, discs, F.lit(apart), 10.0).where(f"earlier < id and dist < {apart} - 1e-6")
    near = near.select("id", "earlier", "floor_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    return floor.visible(near, ["id", "earlier"], shapes, hub=["earlier"]).select("id", "earlier")


def merged_beacons(spark, d) -> DataFrame:
    """Enabled beacons in order of id: each stays unless one that stayed is within 3 m and in sight."""
    b = step(derived(spark, d, "beacon").where("enabled").select(F.col("beacon_id").alias("id"), "floor_id", "x", "y"), "beacons")
    return first_kept(b, near_and_seen(b, APART, coverage.geometry(spark, d))).select(F.col("id").alias("beacon_id"), "kept")


def perimeter_candidates(spark, d) -> DataFrame:
    """Places on both sides of the outlines of walkable areas, every 5.5 m at most, that have no conflict."""
    shapes = coverage.geometry(spark, d)
    s = shapes.sides.where("role = 'walkable' and ring = 0")
    length = G.distance(F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy"))
    n = F.greatest(F.lit(1), F.ceil(length / SPACING).cast("int"))
    s = s.withColumn("length", length).withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("j") / F.col("n")
    x = along("cx", "dx") - F.col("sign") * (F.col("dy") - F.col("cy")) / F.col("length") * INSET
    y = along("cy", "dy") + F.col("sign") * (F.col("dx") - F.col("cx")) / F.col("length") * INSET
    places = s.select("floor_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")).distinct()
    return floor.conflicts(places, ["floor_id", "x", "y"], shapes).where("conflict is null").select("floor_id", "x", "y")


def area_cover(spark, d, additions: int = 3) -> DataFrame:
    """Greedy cover of what no beacon covers yet: per floor, up to ``additions`` times the candidate that covers most dead cells.

    Ties go to the least place. All floors pick at the same time; a round is one
    aggregation over the footprints that are left.
    """
    shapes = coverage.geometry(spark, d)
    cells, near = coverage.cells_and_hits(spark, d)
    dead = step(coverage.count_of(cells, near).where("n = 0").select(*coverage.CELL_KEY, "x", "y"), "dead")
    c = step(perimeter_candidates(spark, d).select("floor_id", F.col("x").alias("cx"), F.col("y").alias("cy")), "candidates")
    pairs = spatial.disc_join(dead, c, F.lit(RADIUS), coverage.BIN)
    lines = pairs.select(*coverage.CELL_KEY, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.struct("floor_id", "cx", "cy").alias("place"))
    prints = step(floor.visible(lines, [*coverage.CELL_KEY, "place"], shapes, True, ["place"]).select(*coverage.CELL_KEY, "place.cx", "place.cy"), "prints")
    picks = []
    for n in range(additions):
        gain = prints.groupBy("floor_id", "cx", "cy").agg(F.count(F.lit(1)).alias("gain"))
        best = step(gain.groupBy("floor_id").agg(F.min(F.struct(-F.col("gain"), "cx", "cy")).alias("b"), F.max("gain").alias("gain")).select("floor_id", F.lit(n + 1).alias("pick"), "b.cx", "b.cy", "gain"), "pick")
        picks.append(best)
        taken = prints.join(best.select("floor_id", "cx", "cy"), ["floor_id", "cx", "cy"], "left_semi").select(*coverage.CELL_KEY)
        prints = step(prints.join(taken, coverage.CELL_KEY, "left_anti"), "prints")
    return reduce(DataFrame.unionByName, picks).select("floor_id", "pick", F.col("cx").alias("x"), F.col("cy").alias("y"), "gain")


def corridor_width_class(spark, d) -> DataFrame:
    """Clear width across each edge at 10, 50 and 90 % of it, up to 100 m to either side: upper median, class, and whether it was cut off."""
    e = coverage.ends(spark, d).select("edge_id", "floor_id", "ax", "ay", F.col("bx_").alias("ex"), F.col("by_").alias("ey"))
    length = G.distance(F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey"))
    e = e.withColumn("length", length).withColumn("part", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    x, y = F.col("ax") + F.col("part") * (F.col("ex") - F.col("ax")), F.col("ay") + F.col("part") * (F.col("ey") - F.col("ay"))
    nx, ny = -(F.col("ey") - F.col("ay")) / F.col("length") * REACH, (F.col("ex") - F.col("ax")) / F.col("length") * REACH
    across = step(e.select("edge_id", "part", "floor_id", (x - nx).alias("ax"), (y - ny).alias("ay"), (x + nx).alias("bx"), (y + ny).alias("by")), "across")
    parts = floor.valid_intervals(across, ["edge_id", "part"], coverage.geometry(spark, d)).where("lo <= 0.5 + 1e-9 and hi >= 0.5 - 1e-9").groupBy("edge_id", "part").agg(F.max((F.col("hi") - F.col("lo")) * 2 * REACH).alias("width"))
    w = across.select("edge_id", "part").join(parts, ["edge_id", "part"], "left").groupBy("edge_id").agg(F.array_sort(F.collect_list(F.round(F.coalesce("width", F.lit(0.0)), 4))).alias("ws"))
    width = F.element_at("ws", 2)
    kind = F.when(width <= 3, "narrow").when(width <= 6, "medium").when(width < 12, "wide").otherwise("open-area")
    return w.select("edge_id", width.alias("width"), kind.alias("kind"), (width >= 2 * REACH - 1e-6).alias("capped"))


CANDIDATE_SQL = floor.SHAPES_SQL.lstrip() + """,
s AS (SELECT floor_id, cx, cy, dx, dy, sqrt(power(dx-cx, 2)+power(dy-cy, 2)) AS length FROM side WHERE role = 'walkable' AND ring = 0),
m AS (SELECT *, greatest(1, CAST(ceil(length / 5.5) AS int)) AS n FROM s),
c AS (SELECT DISTINCT floor_id, round(cx + (dx-cx)*j/n - sign*(dy-cy)/length*0.4, 3) AS x, round(cy + (dy-cy)*j/n + sign*(dx-cx)/length*0.4, 3) AS y FROM m, unnest(range(0, n)) u(j), (VALUES (-1), (1)) v(sign)),
pt AS (SELECT floor_id || ':' || x || ':' || y AS pid, floor_id, x, y FROM c),""" + floor.conflict_sql("pt", "cf")
WIDTH_SQL = f"""+{network.ENDS_SQL}, {floor.SHAPES_SQL.lstrip()},
l AS (SELECT *, sqrt(power(bx-ax, 2)+power(by_-ay, 2)) AS length FROM ends),
p AS (SELECT edge_id, t, floor_id, ax + t*(bx-ax) AS x, ay + t*(by_-ay) AS y, -(by_-ay)/length*100 AS nx, (bx-ax)/length*100 AS ny FROM l, (VALUES (0.1::double), (0.5::double), (0.9::double)) v(t)),
across AS (SELECT edge_id || ':' || t AS sid, edge_id, floor_id, x-nx AS ax, y-ny AS ay, x+nx AS bx, y+ny AS by_ FROM p),{floor.intervals_sql("across", "av", True)},
marked AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS before FROM av), run AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lo ROWS UNBOUNDED PRECEDING) AS r FROM marked),
part AS (SELECT sid, max(w) AS width FROM (SELECT sid, min(lo) AS lo, max(hi) AS hi, (max(hi) - min(lo)) * 200 AS w FROM run GROUP BY sid, r) WHERE lo <= 0.5 + 1e-9 AND hi >= 0.5 - 1e-9 GROUP BY sid),
w AS (SELECT edge_id, list_sort(list(round(coalesce(width, 0), 4)))[2] AS width FROM across LEFT JOIN part USING (sid) GROUP BY edge_id)
SELECT edge_id, width, CASE WHEN width <= 3 THEN 'narrow' WHEN width <= 6 THEN 'medium' WHEN width < 12 THEN 'wide' ELSE 'open-area' END AS kind, width >= 200 - 1e-6 AS capped FROM w"""

QUERIES = {
    "merged_beacons": Query(merged_beacons),
    "perimeter_candidates": Query(perimeter_candidates, with_sql(f"+{CANDIDATE_SQL} SELECT floor_id, x, y FROM cf WHERE conflict IS NULL", "vertex", "capsule")),
    "area_cover": Query(area_cover),
    "corridor_width_class": Query(corridor_width_class, with_sql(WIDTH_SQL, "edge", "vertex", "capsule")),
}
