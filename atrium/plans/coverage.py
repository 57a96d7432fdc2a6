"""Area and route coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, graph, spatial
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import dealt, step

#: Metres along a cell where nothing else is asked for.
CELL = 2.0
BIN = 10.0

GRID_SQL = """extent AS (SELECT floor_id, min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) - min(x)) / 2) AS bigint) AS cols, CAST(ceil((max(y) - min(y)) / 2) AS bigint) AS rows_no FROM vertex WHERE role = 'boundary' GROUP BY floor_id),
cell AS (SELECT floor_id, c AS col, r AS row_no, x0 + (c + 0.5::double) * 2 AS x, y0 + (r + 0.5::double) * 2 AS y
         FROM extent, unnest(range(cols)) a(c), unnest(range(rows_no)) b(r))"""
CELLS_SQL = floor.SHAPES_SQL + """,
""" + GRID_SQL + """,
pt AS (SELECT floor_id * 1000000 + row_no * 1000 + col AS pid, floor_id, x, y FROM cell),""" + floor.conflict_sql("pt", "cf") + """,
open_cell AS (SELECT c.* FROM cell c JOIN cf ON cf.pid = c.floor_id * 1000000 + c.row_no * 1000 + c.col AND cf.conflict IS NULL),
close AS (SELECT c.floor_id, c.col, c.row_no, b.beacon_id, sqrt((c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y)) AS dist, b.radius, b.marginal, c.x AS ax, c.y AS ay, b.x AS bx, b.y AS by_,
         (c.floor_id * 1000000 + c.row_no * 1000 + c.col) * 1000000 + b.beacon_id AS sid
        FROM open_cell c JOIN beacon b ON b.floor_id = c.floor_id AND b.enabled AND sqrt((c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y)) <= b.marginal + 1e-8),""" + floor.intervals_sql("close", "iv", False) + """,
hit AS (SELECT * FROM close WHERE sid IN (SELECT sid FROM iv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7)),
counted AS (SELECT c.floor_id, c.col, c.row_no, c.x, c.y, count(h.beacon_id) AS n
            FROM open_cell c LEFT JOIN hit h ON h.floor_id = c.floor_id AND h.col = c.col AND h.row_no = c.row_no AND h.dist <= h.radius + 1e-8
            GROUP BY ALL)"""
CELL_KEY = ["floor_id", "col", "row_no"]


def geometry(spark, d) -> floor.Geometry:
    return floor.of_rings(derived(spark, d, "vertex"), derived(spark, d, "capsule"))


def grid(vertices: DataFrame, cell: float = CELL, cells: DataFrame | None = None) -> DataFrame:
    """Cell centres (floor_id, col, row_no, x, y, cell) over the box of each floor's boundary, counted from its corner.

    ``cells`` (floor_id, cell) may give each floor a cell size of its own. A floor without a boundary has no cells.
    """
    box = vertices.where("role = 'boundary'").groupBy("floor_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    box = box.join(cells.select("floor_id", "cell"), "floor_id") if cells is not None else box.withColumn("cell", F.lit(cell))
    count = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.col("cell"))
    out = box.withColumn("cols", count("x0", "x1")).withColumn("rows", count("y0", "y1")).where("cols > 0 and rows > 0")
    # Columns are dealt out before rows are made, so no task holds a floor's whole grid, nor the grids of all floors.
    out = dealt(out.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))), "floor_id", "col").withColumn("row_no", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    return out.select("floor_id", "col", "row_no", (F.col("x0") + (F.col("col") + 0.5) * F.col("cell")).alias("x"), (F.col("y0") + (F.col("row_no") + 0.5) * F.col("cell")).alias("y"), "cell")


def open_cells(spark, d, shapes: floor.Geometry, cell: float = CELL, cells: DataFrame | None = None) -> DataFrame:
    """Cell centres of each floor without a conflict."""
    return floor.conflicts(grid(derived(spark, d, "vertex"), cell, cells), CELL_KEY, shapes).where("conflict is null").drop("conflict", "conflict_off_path")


def seen_from(cells: DataFrame, discs: DataFrame, shapes: floor.Geometry) -> DataFrame:
    """Discs (floor_id, beacon_id, cx, cy, radius, marginal) within the marginal radius of a cell and in sight of it."""
    discs = floor.around(discs, "cx", "cy", F.col("marginal") + 1e-6, shapes)
    near = spatial.disc_join(cells, discs, F.col("marginal"), BIN).withColumnsRenamed({"x": "ax", "y": "ay", "cx": "bx", "cy": "by"})
    seen = floor.visible(near, [*CELL_KEY, "beacon_id"], shapes, True)
    return seen.withColumnsRenamed({"ax": "x", "ay": "y", "bx": "cx", "by": "cy"})


def hits(spark, d, cells: DataFrame, shapes: floor.Geometry) -> DataFrame:
    """Enabled beacons within the marginal radius of a cell and in sight of it."""
    discs = derived(spark, d, "beacon").where("enabled").select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", "marginal")
    return step(seen_from(cells, discs, shapes), "hits")


def cells_and_hits(spark, d) -> tuple[DataFrame, DataFrame]:
    shapes = geometry(spark, d)
    cells = step(open_cells(spark, d, shapes), "cells")
    return cells, hits(spark, d, cells, shapes)


def count_of(cells: DataFrame, near: DataFrame) -> DataFrame:
    n = near.where(F.col("dist") <= F.col("radius") + G.EPS).groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, CELL_KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def counted(spark, d) -> DataFrame:
    return count_of(*cells_and_hits(spark, d))


def floor_coverage_summary(spark, d) -> DataFrame:
    area = lambda cond: F.sum(F.when(cond, CELL * CELL).otherwise(0.0))
    n = F.col("n")
    out = counted(spark, d).groupBy("floor_id").agg(F.count(F.lit(1)).alias("cells"), area(n > 0).alias("covered"), area(n > 1).alias("overlap"), area(n == 0).alias("dead"))
    return out.withColumn("coverage_pct", F.round(100 * F.col("covered") / (F.col("covered") + F.col("dead")), 6))


def cell_coverage_class(spark, d) -> DataFrame:
    kind = F.when(F.col("n") == 0, "dead").when(F.col("n") == 1, "single").otherwise("overlap")
    return counted(spark, d).select("floor_id", F.col("col").cast("long").alias("col"), F.col("row_no").cast("long").alias("row_no"), "n", kind.alias("kind"))


def beacon_unique_contribution(spark, d) -> DataFrame:
    near = cells_and_hits(spark, d)[1].where(F.col("dist") <= F.col("radius") + G.EPS).select(*CELL_KEY, "beacon_id")
    own = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*CELL_KEY)))
    return own.groupBy("beacon_id").agg((F.count(F.lit(1)) * CELL * CELL).alias("footprint"), F.sum(F.when(F.col("n") == 1, CELL * CELL).otherwise(0.0)).alias("unique_area"))


def marginal_vs_reliable_coverage(spark, d) -> DataFrame:
    cells, near = cells_and_hits(spark, d)
    best = near.groupBy(*CELL_KEY).agg(F.max((F.col("dist") <= F.col("radius") + G.EPS).cast("int")).alias("ok"))
    cells = cells.join(best, CELL_KEY, "left")
    out = cells.groupBy("floor_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("reliable"), F.sum(F.when(F.col("ok").isNotNull(), 1).otherwise(0)).alias("marginal"))
    both = F.stack(F.lit(2), F.lit("reliable"), F.col("reliable"), F.lit("marginal"), F.col("marginal"))
    return out.select("floor_id", "n", both).select("floor_id", F.col("col0").alias("threshold"), F.round(100 * F.col("col1") / F.col("n"), 6).alias("coverage_pct"))


def dead_zones(spark, d) -> DataFrame:
    """Neighbouring uncovered cells that see each other, as one zone each."""
    cells = step(counted(spark, d).where("n = 0").select("floor_id", F.col("col").cast("long").alias("col"), F.col("row_no").cast("long").alias("row_no"), "x", "y"), "dead")
    zones = graph.grid_components(cells, lambda pairs: floor.visible(pairs, [*CELL_KEY, "to_col", "to_row"], geometry(spark, d), True))
    return zones.groupBy("floor_id", "zone_col", "zone_row").agg(F.count(F.lit(1)).alias("samples"), (F.count(F.lit(1)) * CELL * CELL).alias("area"), F.min("col").alias("col_from"), F.max("col").alias("col_to"), F.min("row_no").alias("row_from"), F.max("row_no").alias("row_to"))


def edge_parts(spark, d) -> DataFrame:
    """Parts of each edge that a beacon's disc covers: (edge_id, floor_id, lo, hi), not merged."""
    edges = ends(spark, d).withColumns({"sx": F.least("ax", "bx_"), "sy": F.least("ay", "by_")})
    lines = spatial.spread(edges, F.col("sx"), F.col("sy"), F.greatest("ax", "bx_"), F.greatest("ay", "by_"), BIN)
    b = derived(spark, d, "beacon").where("enabled").select(F.col("floor_id").alias("f"), F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
    r = F.col("radius")
    b = spatial.spread(b, F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r, BIN).withColumnsRenamed({"bx": "kx", "by": "ky"})
    # A pair comes from the first bin that both boxes touch, so none has to be dropped later.
    first = (F.col("bx") == F.floor(F.greatest("sx", F.col("cx") - r) / BIN)) & (F.col("by") == F.floor(F.greatest("sy", F.col("cy") - r) / BIN))
    pairs = lines.join(b, (F.col("floor_id") == F.col("f")) & (F.col("bx") == F.col("kx")) & (F.col("by") == F.col("ky")) & first)
    lo, hi = G.segment_in_disc(F.col("ax"), F.col("ay"), F.col("bx_"), F.col("by_"), F.col("cx"), F.col("cy"), F.col("radius"))
    return pairs.select("edge_id", "floor_id", lo.alias("lo"), hi.alias("hi")).where("hi - lo > 1e-9")


def ends(spark, d) -> DataFrame:
    """Edges within a floor, with the positions of both ends."""
    node = derived(spark, d, "node").select("node_id", "x", "y", F.col("floor_id").alias("f")).hint("merge")
    e = derived(spark, d, "raw_edge").where("source <> target and distance > 0")
    e = e.join(node.select(F.col("node_id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("f").alias("fa")), "source")
    return e.join(node.select(F.col("node_id").alias("target"), F.col("x").alias("bx_"), F.col("y").alias("by_"), F.col("f").alias("fb")), "target").where("fa = fb").drop("fa", "fb")


def edge_covered_length(spark, d) -> DataFrame:
    merged = spatial.interval_union(edge_parts(spark, d), ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("share"))
    e = ends(spark, d).select("edge_id", "floor_id", "distance").join(merged, "edge_id", "left")
    share = F.coalesce("share", F.lit(0.0))
    return e.select("edge_id", "floor_id", F.round(F.col("distance") * share, 4).alias("covered"), F.round(F.col("distance") * (1 - share), 4).alias("uncovered"))


def graph_gaps(spark, d) -> DataFrame:
    """What no beacon covers of each edge: a gap before each covered part and one after the last."""
    merged = spatial.interval_union(edge_parts(spark, d), ["edge_id"])
    e = ends(spark, d).select("edge_id", "distance").join(merged, "edge_id", "left")
    w = Window.partitionBy("edge_id").orderBy("lo")
    at = F.struct(F.coalesce(F.lag("hi").over(w), F.lit(0.0)).alias("lo"), F.coalesce("lo", F.lit(1.0)).alias("hi"))
    tail = F.when(F.lead("lo").over(w).isNull() & F.col("lo").isNotNull(), F.struct(F.col("hi").alias("lo"), F.lit(1.0).alias("hi")))
    e = e.select("edge_id", "distance", at.alias("at"), tail.alias("tail"))
    gaps = e.select("edge_id", "distance", F.explode(F.array_compact(F.array("at", "tail"))).alias("g")).where("g.hi - g.lo > 1e-9")
    return gaps.select("edge_id", F.round(F.col("g.lo") * F.col("distance"), 4).alias("gap_from"), F.round(F.col("g.hi") * F.col("distance"), 4).alias("gap_to"))


BASE = ("floor", "vertex", "capsule", "beacon")
PARTS_SQL = """
ends AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM edge e JOIN node a ON a.node_id = e.source JOIN node b ON b.node_id = e.target AND b.floor_id = a.floor_id),
quad AS (SELECT e.edge_id, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS a, 2*((ax-c.x)*(bx-ax)+(ay-c.y)*(by_-ay)) AS b, (ax-c.x)*(ax-c.x)+(ay-c.y)*(ay-c.y)-c.radius*c.radius AS c
         FROM ends e JOIN beacon c ON c.floor_id = e.floor_id AND c.enabled),
part AS (SELECT edge_id, greatest(0, (-b-sqrt(b*b-4*a*c))/(2*a)) AS lo, least(1, (-b+sqrt(b*b-4*a*c))/(2*a)) AS hi FROM quad WHERE b*b-4*a*c >= 0),
good AS (SELECT DISTINCT * FROM part WHERE hi - lo > 1e-9),
marked AS (SELECT *, max(hi) OVER (PARTITION BY edge_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good),
run AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS r FROM marked),
merged AS (SELECT edge_id, min(lo) AS lo, max(hi) AS hi FROM run GROUP BY edge_id, r)"""

QUERIES = {
    "floor_coverage_summary": Query(floor_coverage_summary, with_sql("+" + CELLS_SQL + """
        SELECT floor_id, count(*) AS cells, sum(CASE WHEN n > 0 THEN 4.0::double ELSE 0 END) AS covered, sum(CASE WHEN n > 1 THEN 4.0::double ELSE 0 END) AS overlap,
               sum(CASE WHEN n = 0 THEN 4.0::double ELSE 0 END) AS dead, round(100.0::double * count(*) FILTER (n > 0) / count(*), 6) AS coverage_pct
        FROM counted GROUP BY floor_id""", *BASE)),
    "cell_coverage_class": Query(cell_coverage_class, with_sql("+" + CELLS_SQL + """
        SELECT floor_id, col, row_no, n, CASE WHEN n = 0 THEN 'dead' WHEN n = 1 THEN 'single' ELSE 'overlap' END AS kind FROM counted""", *BASE)),
    "beacon_unique_contribution": Query(beacon_unique_contribution, with_sql("+" + CELLS_SQL + """
        SELECT h.beacon_id, count(*) * 4.0::double AS footprint, sum(CASE WHEN c.n = 1 THEN 4.0::double ELSE 0 END) AS unique_area
        FROM hit h JOIN counted c USING (floor_id, col, row_no) WHERE h.dist <= h.radius + 1e-8 GROUP BY h.beacon_id""", *BASE)),
    "marginal_vs_reliable_coverage": Query(marginal_vs_reliable_coverage, with_sql("+" + CELLS_SQL + """
        , best AS (SELECT c.floor_id, c.col, c.row_no, max(CASE WHEN h.dist <= h.radius + 1e-8 THEN 1 ELSE 0 END) AS ok, count(h.beacon_id) AS m
                   FROM open_cell c LEFT JOIN hit h USING (floor_id, col, row_no) GROUP BY ALL)
        SELECT floor_id, 'reliable' AS threshold, round(100.0::double * sum(ok) / count(*), 6) AS coverage_pct FROM best GROUP BY floor_id
        UNION ALL SELECT floor_id, 'marginal', round(100.0::double * count(*) FILTER (m > 0) / count(*), 6) FROM best GROUP BY floor_id""", *BASE)),
    "dead_zones": Query(dead_zones, with_sql("+" + CELLS_SQL + """
        , dead AS (SELECT floor_id, col, row_no, x, y, floor_id * 1000000 + row_no * 1000 + col AS id FROM counted WHERE n = 0),
        pair AS (SELECT a.id * 2 + (CASE WHEN b.id = a.id + 1 THEN 0 ELSE 1 END) AS sid, a.id AS s, b.id AS t, a.floor_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM (SELECT *, id + k AS at FROM dead, (VALUES (1), (1000)) v(k)) a JOIN dead b ON b.id = a.at),""" + floor.intervals_sql("pair", "pv", False) + """,
        free AS (SELECT s, t FROM pair WHERE sid IN (SELECT sid FROM pv GROUP BY sid HAVING sum(hi - lo) >= 1 - 1e-7)),
        link AS (SELECT s, t FROM free UNION ALL SELECT t, s FROM free),
        lab(id, label) USING KEY (id) AS (
          SELECT id, id FROM dead
          UNION SELECT l.t, min(r.label) FROM lab r JOIN link l ON l.s = r.id JOIN recurring.lab o ON o.id = l.t WHERE r.label < o.label GROUP BY l.t)
        SELECT floor_id, label % 1000 AS zone_col, CAST(floor(label / 1000) AS bigint) % 1000 AS zone_row, count(*) AS samples, count(*) * 4.0::double AS area, min(col) AS col_from, max(col) AS col_to, min(row_no) AS row_from, max(row_no) AS row_to
        FROM dead JOIN lab USING (id) GROUP BY floor_id, label -- USING KEY""", *BASE)),
    "edge_covered_length": Query(edge_covered_length, with_sql("+" + PARTS_SQL + """
        SELECT e.edge_id, e.floor_id, round(distance * coalesce(sum(hi - lo), 0), 4) AS covered, round(distance * (1 - coalesce(sum(hi - lo), 0)), 4) AS uncovered
        FROM ends e LEFT JOIN merged m ON m.edge_id = e.edge_id GROUP BY e.edge_id, e.floor_id, distance""", "edge", "beacon")),
    "graph_gaps": Query(graph_gaps, with_sql("+" + PARTS_SQL + """
        , cut AS (SELECT edge_id, coalesce(lag(hi) OVER (PARTITION BY edge_id ORDER BY lo), 0) AS lo, lo AS hi FROM merged
                  UNION ALL SELECT edge_id, max(hi), 1 FROM merged GROUP BY edge_id
                  UNION ALL SELECT edge_id, 0, 1 FROM ends WHERE edge_id NOT IN (SELECT edge_id FROM merged))
        SELECT c.edge_id, round(lo * distance, 4) AS gap_from, round(hi * distance, 4) AS gap_to FROM cut c JOIN ends e ON e.edge_id = c.edge_id WHERE hi - lo > 1e-9""", "edge", "beacon")),
}
