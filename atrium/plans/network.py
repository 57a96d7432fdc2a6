"""Graph checks, components and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, graph, spatial
from atrium.plans.coverage import ends, geometry
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import step


#: Beacons closer than this are duplicates.
DUPLICATE = 0.25
# Metres a second, and what a lift's length counts where lifts are preferred.
WALKING_SPEED = 1.35
LIFT_FACTOR = 0.85


def edge_with_endpoints(spark, d) -> DataFrame:
    e = ends(spark, d)
    return e.select("edge_id", "source", "target", F.round(G.distance(F.col("ax"), F.col("ay"), F.col("bx_"), F.col("by_")), 6).alias("measured"), "distance")


def edge_missing_endpoint(spark, d) -> DataFrame:
    nodes = derived(spark, d, "node").select(F.col("node_id").alias("target"))
    return derived(spark, d, "raw_edge").join(nodes, "target", "left_anti").select("edge_id", "source", "target")


def edge_distance_mismatch(spark, d) -> DataFrame:
    e = edge_with_endpoints(spark, d)
    return e.where(F.abs(F.col("measured") - F.col("distance")) > F.greatest(F.lit(0.001), 0.001 * F.col("measured"))).select("edge_id", "measured", "distance")


def node_degree(spark, d) -> DataFrame:
    return graph.degrees(derived(spark, d, "node"), derived(spark, d, "edge"))


def duplicate_nodes(spark, d) -> DataFrame:
    """Beacon positions as nodes: pairs within 0.5 m, each node's nearest candidate, told once."""
    b = derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y")
    discs = b.select("floor_id", F.col("beacon_id").alias("other_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = spatial.disc_join(b, discs, F.lit(0.5), 2.0).where("beacon_id <> other_id").groupBy("beacon_id").agg(F.min(F.struct(F.round("dist", 9).alias("d"), "other_id")).alias("n"))
    return near.select("beacon_id", F.col("n.other_id").alias("other_id")).where("beacon_id < other_id")


def graph_validation(spark, d) -> DataFrame:
    """All faults of nodes and edges, one row each."""
    raw = derived(spark, d, "raw_edge")
    fault = lambda code, rows, key: rows.select(F.lit(code).alias("code"), F.col(key).alias("id"))
    parts = components(spark, d).select("label").distinct()
    split = parts.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        fault("isolated-node", node_degree(spark, d).where("degree = 0"), "node_id"),
        fault("missing-endpoint", edge_missing_endpoint(spark, d), "edge_id"),
        fault("invalid-loop", raw.where("source = target"), "edge_id"),
        fault("zero-length-edge", raw.where("distance <= 0"), "edge_id"),
        fault("distance-mismatch", edge_distance_mismatch(spark, d), "edge_id"),
        fault("duplicate-node", duplicate_nodes(spark, d), "beacon_id"),
        fault("disconnected-components", split, "n"),
    ])


def components(spark, d) -> DataFrame:
    return graph.components(derived(spark, d, "node"), derived(spark, d, "edge"))


def component_ratio(spark, d) -> DataFrame:
    sizes = components(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("ratio"))


def arcs(spark, d, accessible: bool = False, stairs: bool = True, lift_factor: float = 1.0) -> DataFrame:
    """Directed arcs (a, b, cost, distance, edge_id) under the direction rule and the route's options."""
    e = derived(spark, d, "edge")
    e = e.where("accessible") if accessible else e
    e = e if stairs else e.where("edge_type <> 'Stair Connection'")
    cost = F.col("distance") * F.when(F.col("edge_type") == "Lift Connection", lift_factor).otherwise(1.0)
    one = lambda a, b, where: e.where(where).select(F.col(a).alias("a"), F.col(b).alias("b"), cost.alias("cost"), "distance", "edge_id", "edge_type")
    return one("source", "target", "direction <> 'reverse'").unionByName(one("target", "source", "direction <> 'forward'"))


def lift_nodes(spark, d) -> DataFrame:
    """Where a search on a floor starts if nothing else is asked for: (source, node_id)."""
    return derived(spark, d, "node").where("node_id % 400 = 45").select(F.col("node_id").alias("source"), "node_id")


def on_floor(spark, d, **options) -> DataFrame:
    return arcs(spark, d, **options).where("edge_type <> 'Lift Connection'")


def floor_routes(spark, d, starts: DataFrame | None = None, **options) -> DataFrame:
    """From each start (source, node_id), by default the node at the lift of each floor, by edges that stay on the floor."""
    return graph.routes(lift_nodes(spark, d) if starts is None else starts, on_floor(spark, d, **options))


def shortest_distance(spark, d, starts: DataFrame | None = None, **options) -> DataFrame:
    """Lengths of the shortest routes on a floor: an edge costs its length, so the costs are the lengths."""
    out = graph.costs(lift_nodes(spark, d) if starts is None else starts, on_floor(spark, d, **options))
    return out.select(F.floor(F.col("source") / 400).alias("floor_id"), "node_id", F.col("cost").alias("distance"))


def shortest_distance_accessible(spark, d) -> DataFrame:
    return shortest_distance(spark, d, accessible=True, stairs=False)


def shortest_route(spark, d) -> DataFrame:
    """The edges of each route in their order, and the time at walking speed."""
    r = floor_routes(spark, d)
    return r.select("source", "node_id", F.col("distance"), F.round(F.col("distance") / WALKING_SPEED, 6).alias("seconds"), F.size("path").alias("edges"), F.array_join(F.col("path").cast("array<string>"), ">").alias("route"))


def route_across_floors(spark, d) -> DataFrame:
    """From the first lift node to every node of the building; lifts count 0.85 of their length, the distance told is the real one."""
    first = derived(spark, d, "node").where("node_id = 45").select(F.col("node_id").alias("source"), "node_id")
    return graph.lengths(first, arcs(spark, d, lift_factor=LIFT_FACTOR)).select("node_id", "cost", "distance")


def nodes_within_reach(spark, d) -> DataFrame:
    """Nodes within 30 m of the nearest enabled beacon that stands on a node, over edges without geometry conflicts."""
    starts = derived(spark, d, "beacon").where("enabled").select(F.lit(0).alias("source"), (F.col("floor_id") * 400 + F.col("beacon_id") * 7 % 400).alias("node_id"))
    blocked = blocked_edges(spark, d).select("edge_id")
    return graph.costs(starts, arcs(spark, d).join(blocked, "edge_id", "left_anti"), within=30.0).select("node_id", F.col("cost").alias("distance"))


def linked_components(spark, d) -> DataFrame:
    """Nodes whose component holds an entrance or exit; all others would be removed."""
    c = components(spark, d)
    access = derived(spark, d, "node").where("node_type IN ('Entrance', 'Exit')").select("node_id")
    kept = c.join(access, "node_id", "left_semi").select("label").distinct()
    return c.join(kept, "label", "left_semi").select("node_id", "label")


def duplicate_beacons(spark, d) -> DataFrame:
    b = derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y")
    discs = b.select("floor_id", F.col("beacon_id").alias("other_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    pairs = spatial.disc_join(b, discs, F.lit(DUPLICATE), 2.0).where(f"beacon_id < other_id and dist < {DUPLICATE}")
    return pairs.select("beacon_id", "other_id", F.round("dist", 6).alias("dist"))


def _lines(spark, d) -> DataFrame:
    return ends(spark, d).select("edge_id", "floor_id", "ax", "ay", F.col("bx_").alias("bx"), F.col("by_").alias("by"))


def edge_valid_intervals(spark, d) -> DataFrame:
    """Parts of each edge on walkable ground: inside the building and outside walls and blocked areas."""
    out = floor.valid_intervals(_lines(spark, d), ["edge_id"], geometry(spark, d))
    return out.select("edge_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def blocked_edges(spark, d) -> DataFrame:
    """Edges with a part that is not valid, and how much of them."""
    valid = floor.valid_intervals(_lines(spark, d), ["edge_id"], geometry(spark, d)).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("share"))
    out = ends(spark, d).select("edge_id").join(valid, "edge_id", "left").withColumn("blocked_share", 1 - F.coalesce("share", F.lit(0.0)))
    return out.where("blocked_share > 1e-7").select("edge_id", F.round("blocked_share", 6).alias("blocked_share"))


def mergeable_nodes(spark, d) -> DataFrame:
    return graph.mergeable_nodes(derived(spark, d, "node"), derived(spark, d, "edge"))


def split_edges(spark, d) -> DataFrame:
    """Edges longer than 6 m split in the middle, the others as they are."""
    e = derived(spark, d, "edge")
    part = F.when(F.col("distance") > 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select("edge_id", F.explode(part).alias("part"), F.when(F.col("distance") > 6, F.col("distance") / 2).otherwise(F.col("distance")).alias("length"))


def corridor_chains(spark, d) -> DataFrame:
    """Edges joined through nodes of degree 2: (chain, edges, length)."""
    e = derived(spark, d, "edge")
    links = mergeable_nodes(spark, d).select(F.col("first").alias("source"), F.col("second").alias("target"))
    labels = graph.components(e.select(F.col("edge_id").alias("node_id")), links)
    return labels.join(e, labels["node_id"] == e["edge_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("distance"), 4).alias("length"))


def merge_coincident_nodes(spark, d) -> DataFrame:
    """Beacon positions as points: points at the same place on a floor become the least of them."""
    w = Window.partitionBy("floor_id", "x", "y")
    return derived(spark, d, "beacon").select("beacon_id", F.min("beacon_id").over(w).alias("merged_id"))


#: Metres across which parts of a graph that lie apart are joined.
JOIN_REACH = 6.0


def fragment_links(spark, d, reach: float = JOIN_REACH) -> DataFrame:
    """Links that join parts of the graph over free ground: node by node in order, each near one of another part that is in reach, bin by bin."""
    c = F.col
    nodes = derived(spark, d, "node").select("node_id", "floor_id", "x", "y")
    discs = nodes.select("floor_id", c("node_id").alias("b"), c("x").alias("cx"), c("y").alias("cy"))
    near = spatial.disc_join(nodes.withColumnRenamed("node_id", "a"), discs, F.lit(reach), 10.0).where(f"b < a and dist <= {reach}")
    labels = step(components(spark, d), "labels")
    end = lambda k: labels.select(c("node_id").alias(k), c("label").alias(f"l{k}"))
    near = near.join(end("a"), "a").join(end("b"), "b").where("la <> lb")
    near = step(near.select("a", "b", "floor_id", c("x").alias("ax"), c("y").alias("ay"), c("cx").alias("bx"), c("cy").alias("by")), "near")
    free = floor.valid_intervals(near, ["a", "b"], geometry(spark, d)).groupBy("a", "b").agg(F.sum(c("hi") - c("lo")).alias("share")).where(c("share") >= floor.SEEN)
    bins = lambda p, q: (F.floor(c(q) / reach) - F.floor(c(p) / reach)).alias(f"d{p}")
    ranked = near.join(free.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.struct("a", bins("ax", "bx"), bins("ay", "by"), "b").alias("rank"))
    return graph.spanning_forest(nodes, derived(spark, d, "edge"), ranked).select(c("a").alias("node_id"), c("b").alias("other_id"))


ROUTE_SQL = """
arc AS (SELECT source AS a, target AS b, edge_id, round(distance * {factor}, 6) AS cost, distance FROM {edges} WHERE direction <> 'reverse'
        UNION ALL SELECT target, source, edge_id, round(distance * {factor}, 6), distance FROM {edges} WHERE direction <> 'forward'),
best(s, n, cost, distance, path) USING KEY (s, n) AS (
  SELECT node_id, node_id, 0.0::double, 0.0::double, []::bigint[] FROM node WHERE {start}
  UNION SELECT s, n, m.cost, m.distance, m.path FROM (
    SELECT r.s, arc.b AS n, min(struct_pack(cost := round(r.cost + arc.cost, 6), path := list_append(r.path, arc.edge_id), distance := round(r.distance + arc.distance, 6))) AS m
    FROM best r JOIN arc ON arc.a = r.n GROUP BY r.s, arc.b) x LEFT JOIN recurring.best o USING (s, n)
  WHERE o.cost IS NULL OR m.cost < o.cost OR (m.cost = o.cost AND m.path < o.path))
"""
FLAT = "(SELECT * FROM edge WHERE edge_type <> 'Lift Connection')"
EASY = "(SELECT * FROM edge WHERE edge_type NOT IN ('Lift Connection', 'Stair Connection') AND accessible)"
LABEL_SQL = """
+link AS (SELECT source AS s, target AS t FROM edge UNION SELECT target, source FROM edge),
lab(n, label) USING KEY (n) AS (
  SELECT node_id, node_id FROM node
  UNION SELECT l.t, min(r.label) FROM lab r JOIN link l ON l.s = r.n JOIN recurring.lab o ON o.n = l.t WHERE r.label < o.label GROUP BY l.t)"""
ENDS_SQL = "ends AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM edge e JOIN node a ON a.node_id = e.source JOIN node b ON b.node_id = e.target AND b.floor_id = a.floor_id)"
DEGREE_SQL = "degree AS (SELECT n.node_id, count(e.edge_id) AS degree FROM node n LEFT JOIN (SELECT source AS node_id, edge_id FROM edge UNION ALL SELECT target, edge_id FROM edge) e ON e.node_id = n.node_id GROUP BY n.node_id)"
MISMATCH = "SELECT edge_id, round(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)), 6) AS measured, distance FROM ends WHERE abs(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)) - distance) > greatest(0.001, 0.001 * sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)))"
VALID_SQL = floor.SHAPES_SQL + ", line AS (SELECT edge_id AS sid, floor_id, ax, ay, bx, by_ FROM ends)," + floor.intervals_sql("line", "valid", True)
TWIN_SQL = """twin AS (SELECT a AS beacon_id, n.o AS other_id FROM (SELECT a.beacon_id AS a, min(struct_pack(d := round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 9), o := b.beacon_id)) AS n FROM beacon a JOIN beacon b ON a.floor_id = b.floor_id AND a.beacon_id <> b.beacon_id
         AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.5 + 1e-8 GROUP BY a.beacon_id) WHERE a < n.o)"""
TWO_SQL = "two AS (SELECT node_id, min(edge_id) AS first, max(edge_id) AS second, sum(distance) AS length FROM (SELECT source AS node_id, edge_id, distance FROM edge UNION ALL SELECT target, edge_id, distance FROM edge) GROUP BY node_id HAVING count(*) = 2)"



def _route_sql(edges: str, body: str, start: str = "node_id % 400 = 45", factor: str = "1") -> str:
    return with_sql("+" + ROUTE_SQL.lstrip().format(edges=edges, start=start, factor=factor) + body + " -- USING KEY", "edge")


QUERIES = {
    "edge_with_endpoints": Query(edge_with_endpoints, with_sql(f"+{ENDS_SQL} SELECT edge_id, source, target, round(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)), 6) AS measured, distance FROM ends", "edge")),
    "edge_missing_endpoint": Query(edge_missing_endpoint, with_sql("SELECT edge_id, source, target FROM raw_edge WHERE target NOT IN (SELECT node_id FROM node)", "raw_edge", "node")),
    "edge_distance_mismatch": Query(edge_distance_mismatch, with_sql(f"+{ENDS_SQL} {MISMATCH}", "edge")),
    "node_degree": Query(node_degree, with_sql(f"+{DEGREE_SQL} SELECT node_id, degree FROM degree", "edge")),
    "junction_nodes": Query(lambda s, d: node_degree(s, d).where("degree >= 3"), with_sql(f"+{DEGREE_SQL} SELECT node_id, degree FROM degree WHERE degree >= 3", "edge")),
    "duplicate_nodes": Query(duplicate_nodes, with_sql("+" + TWIN_SQL + " SELECT * FROM twin", "beacon")),
    "graph_validation": Query(graph_validation, with_sql(f"""{LABEL_SQL.lstrip()}, {ENDS_SQL}, {DEGREE_SQL}, {TWIN_SQL}
        SELECT 'isolated-node' AS code, node_id AS id FROM degree WHERE degree = 0
        UNION ALL SELECT 'missing-endpoint', edge_id FROM raw_edge WHERE target NOT IN (SELECT node_id FROM node)
        UNION ALL SELECT 'invalid-loop', edge_id FROM raw_edge WHERE source = target UNION ALL SELECT 'zero-length-edge', edge_id FROM raw_edge WHERE distance <= 0
        UNION ALL SELECT 'distance-mismatch', edge_id FROM ({MISMATCH}) UNION ALL SELECT 'duplicate-node', beacon_id FROM twin
        UNION ALL SELECT 'disconnected-components', n FROM (SELECT count(DISTINCT label) AS n FROM lab) WHERE n > 1""", "edge", "beacon")),
    "components": Query(components, with_sql(LABEL_SQL.lstrip() + " SELECT n AS node_id, label FROM lab", "edge")),
    "component_ratio": Query(component_ratio, with_sql(LABEL_SQL.lstrip() + ", sizes AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n)::double, 6) AS ratio FROM sizes", "edge")),
    "shortest_distance": Query(shortest_distance, _route_sql(FLAT, "SELECT CAST(floor(s / 400) AS bigint) AS floor_id, n AS node_id, distance FROM best")),
    "shortest_distance_accessible": Query(shortest_distance_accessible, _route_sql(EASY, "SELECT CAST(floor(s / 400) AS bigint) AS floor_id, n AS node_id, distance FROM best")),
    "shortest_route": Query(shortest_route, _route_sql(FLAT, "SELECT s AS source, n AS node_id, distance, round(distance / 1.35, 6) AS seconds, len(path) AS edges, array_to_string(path, '>') AS route FROM best")),
    "route_across_floors": Query(route_across_floors, _route_sql("edge", "SELECT n AS node_id, cost, distance FROM best", "node_id = 45", "CASE WHEN edge_type = 'Lift Connection' THEN 0.85::double ELSE 1 END")),
    "nodes_within_reach": Query(nodes_within_reach, with_sql(f"""+{ENDS_SQL}, {VALID_SQL.lstrip()},
        free AS (SELECT e.* FROM edge e WHERE e.edge_id NOT IN (SELECT edge_id FROM ends WHERE edge_id NOT IN (SELECT sid FROM valid GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7))),
        arc AS (SELECT source AS a, target AS b, distance AS cost FROM free WHERE direction <> 'reverse' UNION ALL SELECT target, source, distance FROM free WHERE direction <> 'forward'),
        best(n, cost) USING KEY (n) AS (
          SELECT floor_id * 400 + beacon_id * 7 % 400, 0.0::double FROM beacon WHERE enabled GROUP BY 1
          UNION SELECT x.n, x.c FROM (SELECT arc.b AS n, min(round(r.cost + arc.cost, 6)) AS c FROM best r JOIN arc ON arc.a = r.n GROUP BY arc.b) x LEFT JOIN recurring.best o ON o.n = x.n WHERE x.c <= 30 AND (o.cost IS NULL OR x.c < o.cost))
        SELECT n AS node_id, cost AS distance FROM best -- USING KEY""", "edge", "beacon", "vertex", "capsule")),
    "linked_components": Query(linked_components, with_sql(LABEL_SQL.lstrip() + " SELECT n AS node_id, label FROM lab WHERE label IN (SELECT l.label FROM lab l JOIN node ON node_id = l.n AND node_type IN ('Entrance', 'Exit'))", "edge")),
    "duplicate_beacons": Query(duplicate_beacons, with_sql("SELECT a.beacon_id, b.beacon_id AS other_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS dist FROM beacon a JOIN beacon b ON a.floor_id = b.floor_id AND a.beacon_id < b.beacon_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 0.25", "beacon")),
    "edge_valid_intervals": Query(edge_valid_intervals, with_sql(f"""+{ENDS_SQL}, {VALID_SQL.lstrip()},
        marked AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS before FROM valid),
        run AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lo ROWS UNBOUNDED PRECEDING) AS r FROM marked)
        SELECT sid AS edge_id, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi FROM run GROUP BY sid, r""", "edge", "vertex", "capsule")),
    "blocked_edges": Query(blocked_edges, with_sql(f"""+{ENDS_SQL}, {VALID_SQL.lstrip()}
        SELECT e.edge_id, round(1 - coalesce(sum(v.hi - v.lo), 0), 6) AS blocked_share FROM ends e LEFT JOIN valid v ON v.sid = e.edge_id GROUP BY e.edge_id HAVING 1 - coalesce(sum(v.hi - v.lo), 0) > 1e-7""", "edge", "vertex", "capsule")),
    "mergeable_nodes": Query(mergeable_nodes, with_sql(f"+{TWO_SQL} SELECT node_id, first, second, length FROM two", "edge")),
    "split_edges": Query(split_edges, with_sql("SELECT edge_id, CAST(p AS int) AS part, CASE WHEN distance > 6 THEN distance / 2 ELSE distance END AS length FROM edge, range(2) t(p) WHERE p = 0 OR distance > 6", "edge")),
    "corridor_chains": Query(corridor_chains, with_sql(f"""+{TWO_SQL}, link AS (SELECT first AS s, second AS t FROM two UNION SELECT second, first FROM two),
        lab(n, label) USING KEY (n) AS (SELECT edge_id, edge_id FROM edge
          UNION SELECT l.t, min(r.label) FROM lab r JOIN link l ON l.s = r.n JOIN recurring.lab o ON o.n = l.t WHERE r.label < o.label GROUP BY l.t)
        SELECT label, count(*) AS edges, round(sum(distance), 4) AS length FROM lab JOIN edge ON edge_id = n GROUP BY label""", "edge")),
    "fragment_links": Query(fragment_links, with_sql(LABEL_SQL.lstrip() + ", " + floor.SHAPES_SQL.lstrip() + """,
        pair AS (SELECT a.node_id * 1000000 + b.node_id AS sid, a.node_id AS n, b.node_id AS o, a.floor_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, la.label AS la, lb.label AS lb FROM node a JOIN node b ON b.floor_id = a.floor_id AND b.node_id < a.node_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 6
          JOIN lab la ON la.n = a.node_id JOIN lab lb ON lb.n = b.node_id WHERE la.label <> lb.label),""" + floor.intervals_sql("pair", "pv", True) + """,
        ok AS (SELECT n, o, la, lb, row_number() OVER (ORDER BY n, floor(bx / 6) - floor(ax / 6), floor(by_ / 6) - floor(ay / 6), o) AS k FROM pair WHERE sid IN (SELECT sid FROM pv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7)),
        way AS (SELECT s, t, min(k) AS k FROM (SELECT la AS s, lb AS t, k FROM ok UNION ALL SELECT lb, la, k FROM ok) GROUP BY s, t),
        neck(s, t, k) USING KEY (s, t) AS (
          SELECT s, t, k FROM way
          UNION SELECT b.s, a.t, min(greatest(b.k, a.k)) FROM neck b JOIN way a ON a.s = b.t LEFT JOIN recurring.neck o ON o.s = b.s AND o.t = a.t WHERE b.s <> a.t AND (o.k IS NULL OR greatest(b.k, a.k) < o.k) GROUP BY b.s, a.t)
        SELECT n AS node_id, o AS other_id FROM ok JOIN neck ON s = la AND t = lb AND neck.k = ok.k -- USING KEY""", "edge", "vertex", "capsule")),
    "merge_coincident_nodes": Query(merge_coincident_nodes, with_sql("SELECT beacon_id, min(beacon_id) OVER (PARTITION BY floor_id, x, y) AS merged_id FROM beacon", "beacon")),
}
