"""Walks over a floor: cumulative route, active beacon, handovers, sections and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.plans import coverage, network
from atrium.plans.coverage import BIN
from atrium.plans.query import Query
from atrium.sources.derive import base, derived, with_sql
from atrium.sources.shared import step

# Metres between samples, metres a second.
STEP = 0.25
SPEED = 1.35


def route_segments(spark, d) -> DataFrame:
    """One walk per floor: from the lift node to the node that is farthest on foot, edge by edge."""
    r = network.floor_routes(spark, d)
    w = Window.partitionBy("source").orderBy(F.col("distance").desc(), "node_id")
    walk = r.withColumn("n", F.row_number().over(w)).where("n = 1 and size(path) > 0").select("source", F.posexplode("path").alias("i", "edge_id"))
    e = coverage.ends(spark, d).select("edge_id", "floor_id", "source", "target", "distance", "ax", "ay", F.col("bx_").alias("bx"), F.col("by_").alias("by"))
    s = walk.withColumnRenamed("source", "start").join(e.hint("merge"), "edge_id")
    order = Window.partitionBy("start").orderBy("i")
    # An edge is entered at the end that it shares with the edge before it.
    forth = F.when(F.col("i") == 0, F.col("source") == F.col("start")).otherwise((F.col("source") == F.lag("source").over(order)) | (F.col("source") == F.lag("target").over(order)))
    s = s.withColumn("forth", forth).withColumn("end_at", F.round(F.sum("distance").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6))
    turn = lambda a, b: F.when(F.col("forth"), F.col(a)).otherwise(F.col(b))
    return s.select("floor_id", (F.col("i") + 1).cast("long").alias("seq"), "edge_id", "forth", turn("ax", "bx").alias("ax"), turn("ay", "by").alias("ay"), turn("bx", "ax").alias("bx"), turn("by", "ay").alias("by"), F.round(F.col("end_at") - F.col("distance"), 6).alias("start_at"), "end_at", turn("target", "source").alias("to_node"))


def route_cumulative(spark, d) -> DataFrame:
    return route_segments(spark, d).select("floor_id", "seq", "edge_id", "start_at", "end_at")


#: Metres of a walk that marks and segments meet in.
BLOCK = 8.0


def samples(segments: DataFrame) -> DataFrame:
    """Positions every STEP metres, at the segments' ends and at the end of the floor's longest walk: (floor_id, at, seq, x, y).

    A floor may be walked more than once, as walks go on to other floors where an edge leads there; its marks are those of
    all its walks, and a mark gives one position for each segment it lies on. Marks are many more than the planner takes
    them for, as rows dealt to bins are, so joins with them are told to sort and merge.
    """
    total = segments.groupBy("floor_id").agg(F.max("end_at").alias("total"))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.col("total") / STEP).cast("int") - 1), lambda i: i * STEP)
    marks = total.select("floor_id", F.explode(steps).alias("at")).unionByName(segments.select("floor_id", F.col("end_at").alias("at"))).distinct()
    block = lambda c: F.floor(F.col(c) / BLOCK)
    s = segments.join(total, "floor_id").withColumn("block", F.explode(F.sequence(block("start_at"), block("end_at"))))
    on = (F.col("start_at") <= F.col("at")) & ((F.col("at") < F.col("end_at")) | ((F.col("at") == F.col("total")) & (F.col("end_at") == F.col("total"))))
    return _place(marks.withColumn("block", block("at")).join(s.hint("merge"), ["floor_id", "block"]).where(on))


def _place(rows: DataFrame) -> DataFrame:
    t = (F.col("at") - F.col("start_at")) / (F.col("end_at") - F.col("start_at"))
    return rows.select("floor_id", "at", "seq", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def intervals(segments: DataFrame) -> DataFrame:
    """Stretches between neighbouring samples, placed at their middle: (floor_id, at, seq, x, y, lo, hi)."""
    w = Window.partitionBy("floor_id").orderBy("at")
    s = samples(segments).select("floor_id", F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), "seq").where("hi is not null")
    s = s.join(segments.hint("merge"), ["floor_id", "seq"]).withColumn("at", (F.col("lo") + F.col("hi")) / 2)
    return _place(s).join(s.select("floor_id", "at", "lo", "hi").hint("merge"), ["floor_id", "at"])


def connected(points: DataFrame, spark, d) -> DataFrame:
    """(floor_id, at, active, signal, state) of points (floor_id, at, x, y).

    A beacon connects if it is enabled, stands without conflict, is within its
    marginal radius and in sight. The strongest is active, ties to the least id.
    """
    key = ["floor_id", "at"]
    shapes = coverage.geometry(spark, d)
    b = derived(spark, d, "beacon").where("enabled").select("floor_id", "beacon_id", "x", "y", "radius", "marginal")
    b = floor.conflicts(b, ["beacon_id"], shapes).where("conflict is null")
    discs = floor.around(b.select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", "marginal"), "cx", "cy", F.col("marginal") + 1e-6, shapes)
    points = step(points.select("floor_id", "at", "x", "y"), "points")
    open_points = floor.conflicts(points, key, shapes).where("conflict is null").select("floor_id", "at", "x", "y")
    near = spatial.disc_join(open_points, discs, F.col("marginal"), BIN).withColumnsRenamed({"x": "ax", "y": "ay", "cx": "bx", "cy": "by"})
    seen = floor.visible(near, [*key, "beacon_id"], shapes, True)
    seen = seen.withColumn("signal", F.round(100 * (1 - F.col("dist") / F.col("marginal")), 8))
    best = seen.groupBy(*key).agg(F.max(F.struct("signal", (-F.col("beacon_id")).alias("neg"), (F.col("dist") <= F.col("radius") + G.EPS).alias("ok"))).alias("b"))
    state = F.when(F.col("b").isNull(), "dead").when(F.col("b.ok"), "reliable").otherwise("weak")
    return points.join(best.hint("merge"), key, "left").select(*key, (-F.col("b.neg")).alias("active"), F.round("b.signal", 4).alias("signal"), state.alias("state"))


def route_position_at(spark, d) -> DataFrame:
    return samples(step(route_segments(spark, d), "walk")).select("floor_id", "at", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def active_beacon_per_sample(spark, d, walk: DataFrame | None = None) -> DataFrame:
    """``walk``: the segments, where they are there already."""
    return connected(samples(step(route_segments(spark, d), "walk") if walk is None else walk), spark, d)


def nearest_beacon_per_sample(spark, d) -> DataFrame:
    """The nearest enabled beacon of each sample, in sight or not."""
    c = F.col
    points = samples(step(route_segments(spark, d), "walk")).select(F.struct("floor_id", "at").alias("k"), "floor_id", "x", "y")
    b = derived(spark, d, "beacon").where("enabled").select("floor_id", "beacon_id", c("x").alias("nx"), c("y").alias("ny"))
    out = spatial.nearest(points, "k", b, "beacon_id", G.distance(c("x"), c("y"), c("nx"), c("ny")), (c("nx"), c("ny"), c("nx"), c("ny")))
    # A mark with several positions has the nearest beacon of them all.
    return out.select("k.floor_id", "k.at", "beacon_id", F.round("dist", 6).alias("dist")).distinct()


def handover_events(spark, d, walk: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("floor_id").orderBy("at")
    a = active_beacon_per_sample(spark, d, walk).withColumn("was", F.lag("active").over(w)).where(~F.col("active").eqNullSafe(F.col("was")))
    kind = F.when(F.col("was").isNull(), "connect").when(F.col("active").isNull(), "lost").otherwise("handover")
    return a.select("floor_id", "at", F.col("was").alias("from_beacon"), F.col("active").alias("to_beacon"), kind.alias("kind"))


def walk_events(spark, d) -> DataFrame:
    """All events of a walk in order: start, connections, nodes that are passed, arrival."""
    s = step(route_segments(spark, d), "walk")
    ends = s.groupBy("floor_id").agg(F.max("end_at").alias("total"))
    rank = lambda n: F.lit(n).alias("rank")
    start = ends.select("floor_id", F.lit(0.0).alias("at"), F.lit("start").alias("kind"), F.lit(None).cast("long").alias("ref"), rank(0))
    passed = s.join(ends, "floor_id").where("end_at < total").select("floor_id", F.col("end_at").alias("at"), F.lit("landmark").alias("kind"), F.col("to_node").alias("ref"), rank(2))
    arrival = ends.select("floor_id", F.col("total").alias("at"), F.lit("arrival").alias("kind"), F.lit(None).cast("long").alias("ref"), rank(3))
    links = handover_events(spark, d, s).select("floor_id", "at", "kind", F.col("to_beacon").alias("ref"), rank(1))
    events = start.unionByName(links).unionByName(passed).unionByName(arrival)
    number = F.row_number().over(Window.partitionBy("floor_id").orderBy("at", "rank"))
    return events.select("floor_id", number.cast("long").alias("n"), F.round(F.col("at") / SPEED, 6).alias("seconds"), "kind", "ref")


def _stretches(spark, d) -> DataFrame:
    """Each stretch between samples with the state at its middle; dead where the route's edge is not valid there."""
    s = step(route_segments(spark, d), "walk")
    parts = step(intervals(s), "stretches")
    states = connected(parts, spark, d).select("floor_id", "at", "state")
    lines = s.select("floor_id", "seq", "ax", "ay", "bx", "by")
    valid = floor.valid_intervals(lines, ["floor_id", "seq"], coverage.geometry(spark, d)).withColumnsRenamed({"lo": "v0", "hi": "v1"})
    length = F.col("end_at") - F.col("start_at")
    inside = parts.join(s.select("floor_id", "seq", "start_at", "end_at").hint("merge"), ["floor_id", "seq"]).join(valid.hint("merge"), ["floor_id", "seq"]).where(((F.col("lo") - F.col("start_at")) / length >= F.col("v0") - 1e-9) & ((F.col("hi") - F.col("start_at")) / length <= F.col("v1") + 1e-9))
    out = parts.join(states.hint("merge"), ["floor_id", "at"]).join(inside.select("floor_id", "at", F.lit(True).alias("valid")).distinct().hint("merge"), ["floor_id", "at"], "left")
    return out.select("floor_id", "lo", "hi", F.when(F.col("valid"), F.col("state")).otherwise("dead").alias("state"))


def coverage_sections(spark, d) -> DataFrame:
    """Neighbouring stretches of one state as one section."""
    runs = spatial.islands(_stretches(spark, d), ["floor_id"], ["lo"], "state")
    return runs.groupBy("floor_id", "island", "state").agg(F.min("lo").alias("start_at"), F.max("hi").alias("end_at"))


def handover_stats(spark, d) -> DataFrame:
    """Handovers, connections, mean metres between connections and the largest distance between beacons that follow each other."""
    w = Window.partitionBy("floor_id").orderBy("at")
    place = derived(spark, d, "beacon").select(F.col("beacon_id").alias("to_beacon"), "x", "y")
    c = handover_events(spark, d).where("to_beacon is not null").join(place.hint("merge"), "to_beacon")
    apart = G.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    c = c.withColumn("gap", F.col("at") - F.lag("at").over(w)).withColumn("apart", apart)
    return c.groupBy("floor_id").agg(F.count_if(F.col("kind") == "handover").alias("handovers"), F.count(F.lit(1)).alias("connections"), F.round(F.avg("gap"), 6).alias("mean_metres"), F.round(F.max("apart"), 6).alias("largest_separation"))


def navigation_score(spark, d) -> DataFrame:
    c = step(coverage_sections(spark, d), "sections").withColumn("m", F.col("end_at") - F.col("start_at"))
    pct = lambda cond: 100 * F.sum(F.when(cond, F.col("m")).otherwise(0.0)) / F.sum("m")
    out = c.groupBy("floor_id").agg(pct(F.col("state") == "reliable").alias("rel"), pct(F.col("state") != "dead").alias("cov"), F.coalesce(F.max(F.when(F.col("state") == "dead", F.col("m"))), F.lit(0.0)).alias("gap"))
    score = 0.7 * F.col("rel") + 0.3 * F.col("cov") - F.least(F.lit(30.0), 2.0 * F.col("gap"))
    return out.select("floor_id", F.round("rel", 4).alias("reliable_pct"), F.round("cov", 4).alias("covered_pct"), F.round("gap", 4).alias("longest_gap"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 4).alias("score"))


def state_at(spark, d) -> DataFrame:
    """At each sample: the last change at or before it and the next connection after it."""
    a = step(active_beacon_per_sample(spark, d), "active")
    w = Window.partitionBy("floor_id").orderBy("at")
    a = a.withColumn("changed", ~F.col("active").eqNullSafe(F.lag("active").over(w)))
    change = F.when(F.col("changed"), F.struct("at", "active"))
    link = F.when(F.col("changed") & F.col("active").isNotNull(), F.col("active"))
    a = a.withColumn("last", F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upcoming", F.first(link, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return a.select("floor_id", "at", F.col("last.active").alias("beacon"), F.col("last.at").alias("since"), "upcoming")


def user_state_sessions(spark, d) -> DataFrame:
    e = base(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    runs = spatial.islands(e, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island", F.col("event_type").alias("state")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))


SEG_SQL = network.ROUTE_SQL.lstrip().format(edges=network.FLAT, start="node_id % 400 = 45", factor="1") + ", " + network.ENDS_SQL + """,
far AS (SELECT s AS start, path FROM best WHERE len(path) > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY distance DESC, n) = 1),
leg AS (SELECT start, unnest(path) AS edge_id, generate_subscripts(path, 1) AS seq FROM far),
turned AS (SELECT l.*, e.floor_id, e.source, e.target, e.distance, e.ax, e.ay, e.bx, e.by_, lag(e.source) OVER w AS ps, lag(e.target) OVER w AS pt, sum(e.distance) OVER w AS end_at FROM leg l JOIN ends e USING (edge_id) WINDOW w AS (PARTITION BY start ORDER BY seq)),
seg AS (SELECT floor_id, seq, edge_id, end_at - distance AS start_at, end_at, CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by_ END AS ay, CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by_ ELSE ay END AS by_, CASE WHEN f THEN target ELSE source END AS to_node
        FROM (SELECT *, CASE WHEN seq = 1 THEN source = start ELSE source = ps OR source = pt END AS f FROM turned)),
total AS (SELECT floor_id, max(end_at) AS total FROM seg GROUP BY floor_id),
mark AS (SELECT floor_id, 0.0::double AS at_m FROM total UNION SELECT floor_id, end_at FROM seg UNION SELECT floor_id, k * 0.25::double FROM total, unnest(range(0, CAST(ceil(total * 4) AS bigint))) u(k)),
smp AS (SELECT m.floor_id, m.at_m, s.seq, s.ax + (at_m - start_at) / (end_at - start_at) * (s.bx - s.ax) AS x, s.ay + (at_m - start_at) / (end_at - start_at) * (s.by_ - s.ay) AS y
        FROM mark m JOIN total t USING (floor_id) JOIN seg s ON s.floor_id = m.floor_id AND s.start_at <= m.at_m AND (m.at_m < s.end_at OR (m.at_m = t.total AND s.end_at = t.total)))"""
SHAPES = floor.SHAPES_SQL.lstrip()


def _connected_sql(points: str, out: str) -> str:
    """CTEs that give ``out`` (floor_id, at_m, active, signal, state) for ``points`` (floor_id, at_m, x, y)."""
    return f"""
{out}_pt AS (SELECT floor_id * 10000000 + CAST(round(at_m * 1000) AS bigint) AS pid, floor_id, x, y, at_m FROM {points}), {out}_p AS (SELECT pid, floor_id, x, y FROM {out}_pt),{floor.conflict_sql(out + '_p', out + '_pc')},
{out}_b AS (SELECT beacon_id AS pid, floor_id, x, y FROM beacon WHERE enabled),{floor.conflict_sql(out + '_b', out + '_bc')},
{out}_near AS (SELECT p.pid * 100000 + b.beacon_id AS sid, p.pid, p.floor_id, b.beacon_id, p.x AS ax, p.y AS ay, b.x AS bx, b.y AS by_, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) AS dist, b.radius, b.marginal
          FROM {out}_pc p JOIN {out}_bc c ON c.floor_id = p.floor_id AND c.conflict IS NULL JOIN beacon b ON b.beacon_id = c.pid AND sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) <= b.marginal + 1e-8 WHERE p.conflict IS NULL),{floor.intervals_sql(out + '_near', out + '_iv', False)},
{out}_best AS (SELECT * FROM {out}_near WHERE sid IN (SELECT sid FROM {out}_iv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(100 * (1 - dist / marginal), 8) DESC, beacon_id) = 1),
{out} AS (SELECT p.floor_id, p.at_m, b.beacon_id AS active, round(round(100 * (1 - dist / marginal), 8), 4) AS signal, CASE WHEN b.beacon_id IS NULL THEN 'dead' WHEN dist <= radius + 1e-8 THEN 'reliable' ELSE 'weak' END AS state
        FROM {out}_pt p LEFT JOIN {out}_best b USING (pid))"""


ACTIVE_SQL = f"{SEG_SQL}, {SHAPES},{_connected_sql('smp', 'act')}" + """,
ev AS (SELECT floor_id, at_m, was AS from_beacon, active AS to_beacon, CASE WHEN was IS NULL THEN 'connect' WHEN active IS NULL THEN 'lost' ELSE 'handover' END AS kind
       FROM (SELECT *, lag(active) OVER (PARTITION BY floor_id ORDER BY at_m) AS was FROM act) WHERE active IS DISTINCT FROM was)"""
SECTION_SQL = f"""{SEG_SQL}, {SHAPES},
gap AS (SELECT floor_id, at_m AS lo, lead(at_m) OVER (PARTITION BY floor_id ORDER BY at_m) AS hi, seq FROM smp),
mid AS (SELECT g.floor_id, g.lo, g.hi, g.seq, (g.lo + g.hi) / 2 AS at_m, s.ax + ((g.lo + g.hi) / 2 - start_at) / (end_at - start_at) * (s.bx - s.ax) AS x, s.ay + ((g.lo + g.hi) / 2 - start_at) / (end_at - start_at) * (s.by_ - s.ay) AS y, start_at, end_at
        FROM gap g JOIN seg s USING (floor_id, seq) WHERE g.hi IS NOT NULL),{_connected_sql('mid', 'ms')},
leg_line AS (SELECT floor_id * 1000 + seq AS sid, floor_id, ax, ay, bx, by_ FROM seg),{floor.intervals_sql('leg_line', 'lv', True)},
lv_marked AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS before FROM lv), lv_run AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lo ROWS UNBOUNDED PRECEDING) AS r FROM lv_marked),
legal AS (SELECT sid, min(lo) AS v0, max(hi) AS v1 FROM lv_run GROUP BY sid, r),
stretch AS (SELECT m.floor_id, m.lo, m.hi, CASE WHEN EXISTS (SELECT 1 FROM legal v WHERE v.sid = m.floor_id * 1000 + m.seq AND (m.lo - start_at) / (end_at - start_at) >= v0 - 1e-9 AND (m.hi - start_at) / (end_at - start_at) <= v1 + 1e-9) THEN s.state ELSE 'dead' END AS state
            FROM mid m JOIN ms s USING (floor_id, at_m)),
chg AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM stretch WINDOW w AS (PARTITION BY floor_id ORDER BY lo)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY floor_id ORDER BY lo) AS island FROM chg),
sec AS (SELECT floor_id, CAST(island AS bigint) AS island, state, min(lo) AS start_at, max(hi) AS end_at FROM isl GROUP BY ALL)"""


def _q(sql: str, body: str) -> str:
    return with_sql("+" + sql + " " + body + " -- USING KEY", "edge", "beacon", "vertex", "capsule")


QUERIES = {
    "route_cumulative": Query(route_cumulative, _q(SEG_SQL, "SELECT floor_id, seq, edge_id, start_at, end_at FROM seg")),
    "route_position_at": Query(route_position_at, _q(SEG_SQL, 'SELECT floor_id, at_m AS "at", round(x, 6) AS x, round(y, 6) AS y FROM smp')),
    "nearest_beacon_per_sample": Query(nearest_beacon_per_sample, _q(SEG_SQL, """SELECT floor_id, at_m AS "at", m.i AS beacon_id, round(m.d, 6) AS dist
        FROM (SELECT s.floor_id, s.at_m, min(struct_pack(d := round(sqrt((s.x-b.x)*(s.x-b.x)+(s.y-b.y)*(s.y-b.y)), 9), i := b.beacon_id)) AS m FROM smp s JOIN beacon b ON b.enabled AND b.floor_id = s.floor_id GROUP BY ALL)""")),
    "active_beacon_per_sample": Query(active_beacon_per_sample, _q(ACTIVE_SQL, 'SELECT floor_id, at_m AS "at", active, signal, state FROM act')),
    "handover_events": Query(handover_events, _q(ACTIVE_SQL, 'SELECT floor_id, at_m AS "at", from_beacon, to_beacon, kind FROM ev')),
    "walk_events": Query(walk_events, _q(ACTIVE_SQL, """, e AS (SELECT floor_id, 0.0::double AS at_m, 'start' AS kind, NULL::bigint AS ref, 0 AS rank FROM total UNION ALL SELECT floor_id, at_m, kind, to_beacon, 1 FROM ev
        UNION ALL SELECT s.floor_id, s.end_at, 'landmark', s.to_node, 2 FROM seg s JOIN total t USING (floor_id) WHERE s.end_at < t.total UNION ALL SELECT floor_id, total, 'arrival', NULL, 3 FROM total)
        SELECT floor_id, row_number() OVER (PARTITION BY floor_id ORDER BY at_m, rank) AS n, round(at_m / 1.35, 6) AS seconds, kind, ref FROM e""")),
    "coverage_sections": Query(coverage_sections, _q(SECTION_SQL, "SELECT * FROM sec")),
    "handover_stats": Query(handover_stats, _q(ACTIVE_SQL, """, g AS (SELECT e.*, at_m - lag(at_m) OVER w AS gap, sqrt(power(b.x - lag(b.x) OVER w, 2) + power(b.y - lag(b.y) OVER w, 2)) AS apart FROM ev e JOIN beacon b ON b.beacon_id = e.to_beacon WINDOW w AS (PARTITION BY e.floor_id ORDER BY at_m))
        SELECT floor_id, count(*) FILTER (kind = 'handover') AS handovers, count(*) AS connections, round(avg(gap), 6) AS mean_metres, round(max(apart), 6) AS largest_separation FROM g GROUP BY floor_id""")),
    "navigation_score": Query(navigation_score, _q(SECTION_SQL, """, a AS (SELECT floor_id, 100 * sum(CASE WHEN state = 'reliable' THEN end_at - start_at ELSE 0 END) / sum(end_at - start_at) AS rel, 100 * sum(CASE WHEN state <> 'dead' THEN end_at - start_at ELSE 0 END) / sum(end_at - start_at) AS cov,
          coalesce(max(CASE WHEN state = 'dead' THEN end_at - start_at END), 0) AS gap FROM sec GROUP BY floor_id)
        SELECT floor_id, round(rel, 4) AS reliable_pct, round(cov, 4) AS covered_pct, round(gap, 4) AS longest_gap, round(greatest(0, least(100, 0.7::double * rel + 0.3::double * cov - least(30, 2.0::double * gap))), 4) AS score FROM a""")),
    "state_at": Query(state_at, _q(ACTIVE_SQL, """SELECT s.floor_id, s.at_m AS "at", e.to_beacon AS beacon, e.at_m AS since, (SELECT min(struct_pack(d := u.at_m, b := u.to_beacon)).b FROM ev u WHERE u.floor_id = s.floor_id AND u.at_m > s.at_m AND u.to_beacon IS NOT NULL) AS upcoming
        FROM smp s ASOF LEFT JOIN ev e ON e.floor_id = s.floor_id AND e.at_m <= s.at_m""")),
    "user_state_sessions": Query(user_state_sessions, """WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
        SELECT user_id, CAST(island AS bigint) AS island, event_type AS state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM i GROUP BY ALL"""),
}
