"""Beacon placement: references, conflicts, anchors, spacing and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.plans import coverage, network
from atrium.plans.coverage import BIN, ends
from atrium.plans.query import Query
from atrium.sources.derive import base, derived, with_sql
from atrium.sources.shared import step

# Spacing in metres, anchor types.
TARGET, LEAST, MOST = 5.5, 5.0, 6.0
ANCHORS = ["Entrance", "Exit", "Lift", "Escalator", "Stairs"]
VERTICAL = ["Lift", "Escalator", "Stairs"]


def beacon_nearest_node(spark, d) -> DataFrame:
    n = derived(spark, d, "node").select("floor_id", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    c = F.col
    return spatial.nearest(derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y"), "beacon_id", n, "node_id", G.distance(c("x"), c("y"), c("nx"), c("ny")), (c("nx"), c("ny"), c("nx"), c("ny"))).withColumn("dist", F.round("dist", 6))


def beacon_nearest_edge(spark, d) -> DataFrame:
    e = ends(spark, d).select("floor_id", "edge_id", "ax", "ay", F.col("bx_").alias("ex"), F.col("by_").alias("ey"))
    c = F.col
    box = (F.least("ax", "ex"), F.least("ay", "ey"), F.greatest("ax", "ex"), F.greatest("ay", "ey"))
    return spatial.nearest(derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y"), "beacon_id", e, "edge_id", G.segment_distance(*[c(k) for k in ("x", "y", "ax", "ay", "ex", "ey")]), box).withColumn("dist", F.round("dist", 6))


def beacon_nearest_poi(spark, d) -> DataFrame:
    p = derived(spark, d, "poi").select("floor_id", "poi_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    c = F.col
    return spatial.nearest(derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y"), "beacon_id", p, "poi_id", G.distance(c("x"), c("y"), c("nx"), c("ny")), (c("nx"), c("ny"), c("nx"), c("ny"))).withColumn("dist", F.round("dist", 6))


def too_close_to_wall(spark, d, clearance: float = 0.3) -> DataFrame:
    """Beacons whose distance to a wall's surface is below the clearance, with the nearest wall."""
    c = F.col
    w = derived(spark, d, "capsule").where("kind = 'wall'").withColumnsRenamed({"floor_id": "f", "bx": "ex", "by_": "ey"})
    reach = clearance + c("width") / 2
    w = spatial.spread(w, F.least("ax", "ex") - reach, F.least("ay", "ey") - reach, F.greatest("ax", "ex") + reach, F.greatest("ay", "ey") + reach, BIN).withColumnsRenamed({"bx": "kx", "by": "ky"})
    b = derived(spark, d, "beacon").withColumn("bx", F.floor(c("x") / BIN).cast("int")).withColumn("by", F.floor(c("y") / BIN).cast("int"))
    pairs = b.join(w, (c("floor_id") == c("f")) & (c("bx") == c("kx")) & (c("by") == c("ky")))
    surface = F.greatest(F.lit(0.0), G.segment_distance(*[c(k) for k in ("x", "y", "ax", "ay", "ex", "ey")]) - c("width") / 2)
    near = pairs.withColumn("surface", F.round(surface, 6)).where(c("surface") < clearance)
    return near.groupBy("beacon_id").agg(F.min(F.struct("surface", "path_id")).alias("n")).select("beacon_id", c("n.path_id").alias("wall_id"), c("n.surface").alias("surface"))


def point_conflict(spark, d) -> DataFrame:
    """The first conflict that holds for each beacon, with and without walkable ground asked for."""
    points = derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y")
    return floor.conflicts(points, ["beacon_id"], coverage.geometry(spark, d)).select("beacon_id", "conflict", "conflict_off_path")


def relocation(spark, d) -> DataFrame:
    """For each beacon the nearest valid place of the graph: a node without conflict or a point of an edge's valid part, a little inside it."""
    c, shapes = F.col, coverage.geometry(spark, d)
    b = derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y")
    nodes = floor.conflicts(derived(spark, d, "node").select("node_id", "floor_id", "x", "y"), ["node_id"], shapes).where("conflict is null")
    nodes = step(nodes.select("floor_id", "node_id", c("x").alias("nx"), c("y").alias("ny")), "nodes")
    at_node = spatial.nearest(b, "beacon_id", nodes, "node_id", G.distance(c("x"), c("y"), c("nx"), c("ny")), (c("nx"), c("ny"), c("nx"), c("ny")))
    lines = ends(spark, d).select("edge_id", "floor_id", "ax", "ay", c("bx_").alias("bx"), c("by_").alias("by"))
    parts = floor.valid_intervals(lines, ["edge_id"], shapes).join(lines, "edge_id")
    length = G.distance(c("ax"), c("ay"), c("bx"), c("by"))
    margin = F.least((c("hi") - c("lo")) / 4, 1e-5 / F.greatest(length, F.lit(1e-5)))
    parts = step(parts.select("floor_id", F.struct("edge_id", "lo").alias("part"), "ax", "ay", c("bx").alias("ex"), c("by").alias("ey"), (c("lo") + margin).alias("t0"), (c("hi") - margin).alias("t1")), "parts")
    t = F.greatest(c("t0"), F.least(c("t1"), G.along(*[c(k) for k in ("x", "y", "ax", "ay", "ex", "ey")])))
    to_part = G.distance(c("x"), c("y"), c("ax") + t * (c("ex") - c("ax")), c("ay") + t * (c("ey") - c("ay")))
    box = (F.least("ax", "ex"), F.least("ay", "ey"), F.greatest("ax", "ex"), F.greatest("ay", "ey"))
    at_edge = spatial.nearest(b, "beacon_id", parts, "part", to_part, box)
    both = at_node.select("beacon_id", c("dist").alias("node_dist"), "node_id").join(at_edge.select("beacon_id", c("dist").alias("edge_dist"), c("part.edge_id").alias("edge_id")), "beacon_id", "full")
    first = c("edge_dist").isNull() | (c("node_dist") <= c("edge_dist"))
    return both.select("beacon_id", F.when(first, c("node_id")).alias("node_id"), F.when(first, F.lit(None)).otherwise(c("edge_id")).alias("edge_id"), F.round(F.when(first, c("node_dist")).otherwise(c("edge_dist")), 4).alias("dist"))


def required_anchors(spark, d) -> DataFrame:
    """Nodes that need a beacon: by their type, as junctions, or where an edge leaves the floor."""
    degree = network.node_degree(spark, d)
    node = derived(spark, d, "node")
    floors = node.select(F.col("node_id").alias("target"), F.col("floor_id").alias("other"))
    across = derived(spark, d, "edge").join(floors, "target").where("floor_id <> other").select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("across", F.lit(True))
    n = node.join(degree, "node_id").join(across, "node_id", "left")
    why = F.when(F.col("node_type").isin(ANCHORS), "type").when(F.col("degree") >= 3, "junction").when(F.col("across"), "transition")
    return n.select("node_id", "floor_id", why.alias("reason")).where("reason is not null")


def missing_anchors(spark, d) -> DataFrame:
    """Required anchors without an enabled beacon that is within its reliable radius and in sight."""
    need = step(required_anchors(spark, d).join(derived(spark, d, "node").select("node_id", "x", "y"), "node_id"), "need")
    discs = derived(spark, d, "beacon").where("enabled").select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
    near = spatial.disc_join(need, discs, F.col("radius"), BIN).select("node_id", "beacon_id", "floor_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    met = floor.visible(near, ["node_id", "beacon_id"], coverage.geometry(spark, d), hub=["beacon_id"]).select("node_id").distinct()
    return need.join(met, "node_id", "left_anti").select("node_id", "floor_id", "reason")


def crowded_beacons(spark, d) -> DataFrame:
    """Pairs of enabled beacons closer than 3 m that see each other: (beacon_id, first), the least earlier one of each."""
    b = derived(spark, d, "beacon").where("enabled").select("beacon_id", "floor_id", "x", "y")
    discs = b.select("floor_id", F.col("beacon_id").alias("other_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = spatial.disc_join(b, discs, F.lit(3.0), BIN).where("other_id < beacon_id and dist < 3 - 1e-6")
    near = near.select("beacon_id", "other_id", "floor_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    seen = floor.visible(near, ["beacon_id", "other_id"], coverage.geometry(spark, d), hub=["other_id"])
    return seen.groupBy("beacon_id").agg(F.min("other_id").alias("first"), F.count(F.lit(1)).alias("others"))


def station_positions(spark, d) -> DataFrame:
    """Even stations inside each corridor chain: as many as fit the spacing limits best."""
    c = network.corridor_chains(spark, d)
    n0, low, high = F.floor(F.col("length") / TARGET + 0.5), F.ceil(F.col("length") / MOST), F.floor(F.col("length") / LEAST)
    n = F.greatest(F.lit(1), F.when(low <= high, F.greatest(low, F.least(high, n0))).otherwise(n0)).cast("int")
    c = c.withColumn("n", n).where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    return c.select(F.col("label").alias("chain"), "i", F.round(F.col("length") * F.col("i") / F.col("n"), 4).alias("offset"))


def spacing_samples(spark, d) -> DataFrame:
    """Beacons projected on their nearest edge, put in the order of its offset: the gap to the one before, and whether it is too small or too large."""
    near = beacon_nearest_edge(spark, d).where("dist <= 6")
    e = ends(spark, d)
    b = derived(spark, d, "beacon").where("enabled").select("beacon_id", "x", "y").join(near, "beacon_id").join(e.drop("floor_id"), "edge_id")
    at = G.along(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx_", "by_")]) * F.col("distance")
    w = Window.partitionBy("edge_id").orderBy("at", "beacon_id")
    gaps = b.withColumn("at", F.round(at, 6)).withColumn("gap", F.round(F.col("at") - F.lag("at").over(w), 6)).where("gap is not null")
    kind = F.when(F.col("gap") < LEAST - 1e-6, "spacing-too-small").when(F.col("gap") > MOST + 1e-6, "spacing-too-large").otherwise("ok")
    return gaps.select("edge_id", "beacon_id", "gap", kind.alias("kind"))


def quality_scores(spark, d) -> DataFrame:
    """Spacing, coverage, connectivity and anchor scores of the whole deployment, each 0 to 100, and their mean; 0 if an enabled beacon has a conflict."""
    # Each fact is worked out and written by itself: the driver holds the plan and the broadcasts of one, not of all.
    one = lambda df, value, name: step(df.agg(value.cast("double").alias("v")).select(F.lit(name).alias("k"), "v"), "fact")
    count = F.count(F.lit(1))
    gaps, active = step(spacing_samples(spark, d), "gaps"), derived(spark, d, "beacon").where("enabled")
    dup = network.duplicate_beacons(spark, d).join(active.select("beacon_id"), "beacon_id", "left_semi").join(active.select(F.col("beacon_id").alias("other_id")), "other_id", "left_semi")
    facts = reduce(DataFrame.unionByName, [
        one(coverage.floor_coverage_summary(spark, d), 100 * F.sum("covered") / (F.sum("covered") + F.sum("dead")), "coverage"),
        one(required_anchors(spark, d), count, "need"), one(missing_anchors(spark, d), count, "miss"), one(network.component_ratio(spark, d), F.max("ratio"), "ratio"),
        one(gaps, count, "gaps"), one(gaps.where("kind = 'ok'"), count, "good"), one(gaps.where("kind = 'spacing-too-large'"), count, "broken"),
        one(dup, F.count_distinct("beacon_id"), "dup"), one(active, count, "active"), one(ends(spark, d), count, "edges"), one(network.blocked_edges(spark, d), count, "blocked"),
        one(point_conflict(spark, d).where("conflict is not null").join(active, "beacon_id", "left_semi"), count, "failures"),
    ]).groupBy().pivot("k", ["coverage", "need", "miss", "ratio", "gaps", "good", "broken", "dup", "active", "edges", "blocked", "failures"]).agg(F.first("v"))
    c = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 4)
    out = facts.select(
        clamp(100 * share(c("good"), c("gaps")) * (1 - share(c("dup"), c("active")))).alias("spacing"),
        clamp(c("coverage")).alias("coverage"),
        clamp(100 * c("ratio") * (1 - share(c("broken"), c("gaps"))) * (1 - share(c("blocked"), c("edges")))).alias("connectivity"),
        clamp(100 * (1 - share(c("miss"), c("need")))).alias("anchors"),
        c("failures").cast("long").alias("failures"),
    )
    mean = (F.col("spacing") + F.col("coverage") + F.col("connectivity") + F.col("anchors")) / 4
    return out.withColumn("score", F.round(F.when(F.col("failures") > 0, 0.0).otherwise(mean), 3)).withColumn("uncapped", F.round(mean, 3))


def deployment_statistics(spark, d) -> DataFrame:
    b = derived(spark, d, "beacon")
    return b.groupBy("floor_id").agg(F.count(F.lit(1)).alias("beacons"), F.count_if("enabled").alias("active"), F.round(F.avg("radius"), 6).alias("mean_radius"), (F.count_if("enabled") * 25.0).alias("cost"))


def strategy_histogram(spark, d) -> DataFrame:
    return derived(spark, d, "beacon").groupBy("floor_id", "strategy").agg(F.count(F.lit(1)).alias("n"))


def version_latest(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return base(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("score"))


def version_compare(spark, d) -> DataFrame:
    """Each project's last version against the one before, metric by metric."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = base(spark, d, "orders").withColumn("a", F.lag("o_totalprice").over(w)).withColumn("pa", F.lag("o_orderpriority").over(w)).withColumn("n", F.lead("o_orderkey").over(w))
    v = v.where("n is null and a is not null")
    rank = lambda c: F.substring(c, 1, 1).cast("double")
    both = F.stack(F.lit(2), F.lit("price"), F.col("a"), F.col("o_totalprice"), F.lit("priority"), rank("pa"), rank("o_orderpriority"))
    return v.select("o_custkey", both).select("o_custkey", F.col("col0").alias("metric"), F.round("col1", 2).alias("a"), F.round("col2", 2).alias("b"), F.round(F.col("col2") - F.col("col1"), 2).alias("delta"))


D = "sqrt((b.x-t.x)*(b.x-t.x)+(b.y-t.y)*(b.y-t.y))"
NEAREST = """
+pair AS (SELECT b.beacon_id, t.{t}_id, round(%s, 9) AS dd FROM beacon b JOIN {t} t ON t.floor_id = b.floor_id)
SELECT beacon_id, s.i AS {t}_id, round(s.d, 6) AS dist FROM (SELECT beacon_id, min(struct_pack(d := dd, i := {t}_id)) AS s FROM pair GROUP BY beacon_id)""" % D
ANCHOR_SQL = network.DEGREE_SQL + ", " + floor.SHAPES_SQL.lstrip() + """,
across AS (SELECT unnest([source, target]) AS node_id FROM edge e JOIN node t ON t.node_id = e.target WHERE t.floor_id <> e.floor_id),
need AS (SELECT node_id, floor_id, x, y, CASE WHEN node_type IN ('Entrance', 'Exit', 'Lift', 'Escalator', 'Stairs') THEN 'type' WHEN degree >= 3 THEN 'junction' WHEN node_id IN (SELECT node_id FROM across) THEN 'transition' END AS reason
        FROM node JOIN degree USING (node_id)), needed AS (SELECT * FROM need WHERE reason IS NOT NULL),
near AS (SELECT n.node_id * 1000000 + b.beacon_id AS sid, n.node_id, n.floor_id, n.x AS ax, n.y AS ay, b.x AS bx, b.y AS by_ FROM needed n JOIN beacon b ON b.enabled AND b.floor_id = n.floor_id AND sqrt((b.x-n.x)*(b.x-n.x)+(b.y-n.y)*(b.y-n.y)) <= b.radius + 1e-8),""" + floor.intervals_sql("near", "nv", False) + """,
missed AS (SELECT node_id, floor_id, reason FROM needed WHERE node_id NOT IN (SELECT node_id FROM near WHERE sid IN (SELECT sid FROM nv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7)))"""
WALL_SQL = floor.SHAPES_SQL.lstrip() + f""", near AS (SELECT p.beacon_id, s.path_id, round(greatest(0, {floor._DIST} - s.width / 2), 6) AS surface FROM beacon p JOIN cap s ON s.floor_id = p.floor_id AND s.kind = 'wall')"""
CROWD_SQL = floor.SHAPES_SQL.lstrip() + """,
near AS (SELECT a.beacon_id * 1000000 + b.beacon_id AS sid, a.beacon_id, b.beacon_id AS other_id, a.floor_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM beacon a JOIN beacon b ON a.enabled AND b.enabled AND b.floor_id = a.floor_id AND b.beacon_id < a.beacon_id
         AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 3 - 1e-6),""" + floor.intervals_sql("near", "nv", False)
NEAR_EDGE_SQL = f"""{network.ENDS_SQL},
        t AS (SELECT b.beacon_id, e.edge_id, b.x, b.y, ax, ay, bx, by_, greatest(0, least(1, ((b.x-ax)*(bx-ax)+(b.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t FROM beacon b JOIN ends e ON e.floor_id = b.floor_id),
        pair AS (SELECT beacon_id, edge_id, round(sqrt(power(x-ax-t*(bx-ax), 2) + power(y-ay-t*(by_-ay), 2)), 9) AS dd FROM t),
        best AS (SELECT beacon_id, s.i AS edge_id, round(s.d, 6) AS dist FROM (SELECT beacon_id, min(struct_pack(d := dd, i := edge_id)) AS s FROM pair GROUP BY beacon_id))"""
GAP_SQL = NEAR_EDGE_SQL + """,
        on_edge AS (SELECT b.beacon_id, e.edge_id, round(greatest(0, least(1, ((b.x-ax)*(bx-ax)+(b.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * distance, 6) AS pos FROM best n JOIN beacon b USING (beacon_id) JOIN ends e USING (edge_id) WHERE b.enabled AND dist <= 6),
        gap AS (SELECT edge_id, beacon_id, round(pos - lag(pos) OVER (PARTITION BY edge_id ORDER BY pos, beacon_id), 6) AS gap FROM on_edge),
        spacing AS (SELECT *, CASE WHEN gap < 5 - 1e-6 THEN 'spacing-too-small' WHEN gap > 6 + 1e-6 THEN 'spacing-too-large' ELSE 'ok' END AS kind FROM gap WHERE gap IS NOT NULL)"""
CONFLICT_SQL = floor.SHAPES_SQL.lstrip() + ", pt AS (SELECT beacon_id AS pid, floor_id, x, y FROM beacon)," + floor.conflict_sql("pt", "cf")
CHAIN_SQL = network.QUERIES["corridor_chains"].sql

QUERIES = {
    "beacon_nearest_node": Query(beacon_nearest_node, with_sql(NEAREST.lstrip().format(t="node"), "beacon", "node")),
    "beacon_nearest_poi": Query(beacon_nearest_poi, with_sql(NEAREST.lstrip().format(t="poi"), "beacon", "poi")),
    "beacon_nearest_edge": Query(beacon_nearest_edge, with_sql(f"+{NEAR_EDGE_SQL} SELECT * FROM best", "edge", "beacon")),
    "too_close_to_wall": Query(too_close_to_wall, with_sql(f"+{WALL_SQL} SELECT beacon_id, n.i AS wall_id, n.s AS surface FROM (SELECT beacon_id, min(struct_pack(s := surface, i := path_id)) AS n FROM near WHERE surface < 0.3 GROUP BY beacon_id)", "beacon", "vertex", "capsule")),
    "point_conflict": Query(point_conflict, with_sql(f"+{CONFLICT_SQL} SELECT pid AS beacon_id, conflict, conflict_off_path FROM cf", "beacon", "vertex", "capsule")),
    "relocation": Query(relocation, with_sql(f"""+{network.ENDS_SQL}, {network.VALID_SQL.lstrip()}, pt AS (SELECT node_id AS pid, floor_id, x, y FROM node),{floor.conflict_sql("pt", "nf")},
        marked AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS before FROM valid),
        run AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lo ROWS UNBOUNDED PRECEDING) AS r FROM marked),
        part AS (SELECT e.*, p.lo, least((p.hi-p.lo)/4, 1e-5/greatest(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)), 1e-5)) AS m, p.hi FROM (SELECT sid AS edge_id, min(lo) AS lo, max(hi) AS hi FROM run GROUP BY sid, r) p JOIN ends e USING (edge_id)),
        t AS (SELECT b.beacon_id, p.*, b.x, b.y, greatest(lo + m, least(hi - m, greatest(0, least(1, ((b.x-ax)*(bx-ax)+(b.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))))) AS t FROM beacon b JOIN part p ON p.floor_id = b.floor_id),
        te AS (SELECT beacon_id, min(struct_pack(d := round(sqrt(power(x-ax-t*(bx-ax), 2) + power(y-ay-t*(by_-ay), 2)), 9), i := edge_id)) AS e FROM t GROUP BY beacon_id),
        tn AS (SELECT b.beacon_id, min(struct_pack(d := round(sqrt(power(b.x-n.x, 2) + power(b.y-n.y, 2)), 9), i := n.pid)) AS n FROM beacon b JOIN nf n ON n.floor_id = b.floor_id AND n.conflict IS NULL GROUP BY b.beacon_id)
        SELECT beacon_id, CASE WHEN e IS NULL OR n.d <= e.d THEN n.i END AS node_id, CASE WHEN e IS NULL OR n.d <= e.d THEN NULL ELSE e.i END AS edge_id, round(CASE WHEN e IS NULL OR n.d <= e.d THEN n.d ELSE e.d END, 4) AS dist FROM te FULL JOIN tn USING (beacon_id)""", "edge", "beacon", "vertex", "capsule")),
    "crowded_beacons": Query(crowded_beacons, with_sql(f"+{CROWD_SQL} SELECT beacon_id, min(other_id) AS first, count(*) AS others FROM near WHERE sid IN (SELECT sid FROM nv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7) GROUP BY beacon_id", "beacon", "vertex", "capsule")),
    "spacing_samples": Query(spacing_samples, with_sql(f"+{GAP_SQL} SELECT * FROM spacing", "edge", "beacon")),
    "required_anchors": Query(required_anchors, with_sql(f"+{ANCHOR_SQL} SELECT node_id, floor_id, reason FROM needed", "edge", "beacon", "vertex", "capsule")),
    "missing_anchors": Query(missing_anchors, with_sql(f"+{ANCHOR_SQL} SELECT node_id, floor_id, reason FROM missed", "edge", "beacon", "vertex", "capsule")),
    "station_positions": Query(station_positions, f"""WITH c AS ({CHAIN_SQL}), k AS (SELECT *, floor(length / 5.5::double + 0.5) AS n0, ceil(length / 6.0::double) AS lo, floor(length / 5.0::double) AS hi FROM c),
        m AS (SELECT label, length, CAST(greatest(1, CASE WHEN lo <= hi THEN greatest(lo, least(hi, n0)) ELSE n0 END) AS int) AS n FROM k)
        SELECT label AS chain, CAST(i AS int) AS i, round(length * i / n, 4) AS "offset" FROM m, unnest(range(1, n)) u(i)"""),
    "quality_scores": Query(quality_scores, f"""WITH cov AS ({coverage.QUERIES['floor_coverage_summary'].sql}), need AS ({with_sql('+' + ANCHOR_SQL + ' SELECT node_id FROM needed', 'edge', 'beacon', 'vertex', 'capsule')}),
        miss AS ({with_sql('+' + ANCHOR_SQL + ' SELECT node_id FROM missed', 'edge', 'beacon', 'vertex', 'capsule')}), ratio AS ({network.QUERIES['component_ratio'].sql}), pairs AS ({network.QUERIES['duplicate_beacons'].sql}), blocked AS ({network.QUERIES['blocked_edges'].sql}),
        edges AS ({network.QUERIES['edge_with_endpoints'].sql}), sp AS ({with_sql('+' + GAP_SQL + ' SELECT * FROM spacing', 'edge', 'beacon')}), bad AS ({with_sql('+' + CONFLICT_SQL + ' SELECT pid FROM cf WHERE conflict IS NOT NULL AND pid IN (SELECT beacon_id FROM beacon WHERE enabled)', 'beacon', 'vertex', 'capsule')}),
        active AS ({with_sql('SELECT beacon_id FROM beacon WHERE enabled', 'beacon')}), dup AS (SELECT DISTINCT beacon_id FROM pairs WHERE beacon_id IN (FROM active) AND other_id IN (FROM active)),
        f AS (SELECT (SELECT count(*) FROM need)::double AS need, (SELECT count(*) FROM miss)::double AS miss, (SELECT ratio FROM ratio) AS ratio, (SELECT count(*) FROM sp)::double AS gaps, (SELECT count(*) FROM sp WHERE kind = 'ok')::double AS good,
              (SELECT count(*) FROM sp WHERE kind = 'spacing-too-large')::double AS broken, (SELECT count(*) FROM dup)::double AS dup, (SELECT count(*) FROM active)::double AS active, (SELECT count(*) FROM edges)::double AS edges, (SELECT count(*) FROM blocked)::double AS blocked,
              (SELECT count(*) FROM bad) AS failures, (SELECT 100.0::double * sum(covered) / (sum(covered) + sum(dead)) FROM cov) AS cover),
        p AS (SELECT round(100 * good / greatest(gaps, 1) * (1 - dup / greatest(active, 1)), 4) AS spacing, round(cover, 4) AS coverage, round(100 * ratio * (1 - broken / greatest(gaps, 1)) * (1 - blocked / greatest(edges, 1)), 4) AS connectivity,
                     round(100 * (1 - miss / greatest(need, 1)), 4) AS anchors, failures FROM f)
        SELECT *, round(CASE WHEN failures > 0 THEN 0 ELSE (spacing + coverage + connectivity + anchors) / 4 END, 3) AS score, round((spacing + coverage + connectivity + anchors) / 4, 3) AS uncapped FROM p"""),
    "deployment_statistics": Query(deployment_statistics, with_sql("SELECT floor_id, count(*) AS beacons, count(*) FILTER (enabled) AS active, round(avg(radius), 6) AS mean_radius, count(*) FILTER (enabled) * 25.0::double AS cost FROM beacon GROUP BY floor_id", "beacon")),
    "strategy_histogram": Query(strategy_histogram, with_sql("SELECT floor_id, strategy, count(*) AS n FROM beacon GROUP BY floor_id, strategy", "beacon")),
    "version_latest": Query(version_latest, "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "version_compare": Query(version_compare, """WITH v AS (SELECT *, lag(o_totalprice) OVER w AS pa, lag(o_orderpriority) OVER w AS pp, lead(o_orderkey) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        l AS (SELECT * FROM v WHERE n IS NULL AND pa IS NOT NULL)
        SELECT o_custkey, 'price' AS metric, round(pa, 2) AS a, round(o_totalprice, 2) AS b, round(o_totalprice - pa, 2) AS delta FROM l
        UNION ALL SELECT o_custkey, 'priority', left(pp, 1)::double, left(o_orderpriority, 1)::double, left(o_orderpriority, 1)::double - left(pp, 1)::double FROM l"""),
}
