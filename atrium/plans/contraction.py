"""Graphs made smaller, and the middle lines of open ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import contract, paths, skeleton
from atrium.plans import coverage, network
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import step

#: Nodes at which a dead end is none.
DOORS = ("Entrance", "Exit", "Room Entrance")
#: Links shorter than this (metres) are contracted.
SHORT = 2.0


def _edges(spark, d) -> DataFrame:
    return derived(spark, d, "edge").select("edge_id", "source", "target", F.col("distance").alias("length"))


def corridor_order(spark, d) -> DataFrame:
    """The edges of each corridor chain in their order, with the way they are walked and how far along they start."""
    out = contract.chains(_edges(spark, d))
    return out.select("chain", "seq", "edge_id", "a", "b", F.round("offset", 4).alias("offset"), "edges", "closed")


def merged_corridors(spark, d) -> DataFrame:
    """Corridor chains as single edges, with the direction in which a chain can be walked (both, forward, reverse or none) and whether all of it is accessible."""
    order = contract.chains(_edges(spark, d))
    e = derived(spark, d, "edge").select("edge_id", "source", "direction", "accessible")
    along = order.join(e, "edge_id").withColumn("with", F.col("a") == F.col("source"))
    ahead = (F.col("direction") == "both") | (F.col("with") == (F.col("direction") == "forward"))
    behind = (F.col("direction") == "both") | (F.col("with") == (F.col("direction") == "reverse"))
    out = along.groupBy("chain").agg(F.min_by("a", "seq").alias("source"), F.max_by("b", "seq").alias("target"), F.round(F.sum("length"), 4).alias("length"), F.bool_and(ahead).alias("ahead"), F.bool_and(behind).alias("behind"), F.bool_and("accessible").alias("accessible"))
    way = F.when(F.col("ahead") & F.col("behind"), "both").when(F.col("ahead"), "forward").when(F.col("behind"), "reverse").otherwise("none")
    return out.select("chain", "source", "target", "length", way.alias("direction"), "accessible")


def edges_without_dead_ends(spark, d) -> DataFrame:
    """Edges that are left when dead ends are taken off, but for those that lead to a door."""
    doors = derived(spark, d, "node").where(F.col("node_type").isin(*DOORS)).select("node_id")
    return contract.pruned(_edges(spark, d), doors)


def routing_links(spark, d) -> DataFrame:
    """The drawn paths as a graph for routing: no dead ends, chains as one link, links under 2 m contracted."""
    nodes, edges = paths.graph_of_paths(derived(spark, d, "walk_path"))
    place = F.struct("floor_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    at = nodes.select("node_id", place.alias("place"))
    end = lambda k: at.select(F.col("node_id").alias(k), F.col("place").alias(f"{k}_place"))
    placed = edges.join(end("source"), "source").join(end("target"), "target")
    way = F.struct(F.least("source_place", "target_place"), F.greatest("source_place", "target_place"))
    links = step(placed.select(way.alias("edge_id"), F.least("source_place", "target_place").alias("source"), F.greatest("source_place", "target_place").alias("target"), F.col("distance").alias("length")), "links")
    left = contract.merged(contract.pruned(links)).drop("edges")
    now, _ = contract.contracted(left, SHORT)
    return now.select("source.floor_id", F.col("source.x").alias("ax"), F.col("source.y").alias("ay"), F.col("target.x").alias("bx"), F.col("target.y").alias("by"), F.round("length", 4).alias("length"))


def _open(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = step(coverage.open_cells(spark, d, coverage.geometry(spark, d)).select("floor_id", "col", "row_no"), "open")
    sizes = coverage.grid(derived(spark, d, "vertex")).groupBy("floor_id").agg((F.max("col") + 1).alias("width"), (F.max("row_no") + 1).alias("height"))
    return cells, sizes


def middle_cells(spark, d) -> DataFrame:
    """What thinning leaves of the open ground of each floor."""
    return skeleton.thinned(*_open(spark, d)).select("floor_id", "col", "row_no")


def middle_lines(spark, d) -> DataFrame:
    """The graph of the middle lines of the open ground, straight runs as one edge; ends as cells, the least first."""
    e = skeleton.graph_of_mask(*_open(spark, d))
    turn = F.struct("ar", "ac") > F.struct(F.col("br").alias("ar"), F.col("bc").alias("ac"))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return e.select("floor_id", pick("ac", "bc").alias("from_col"), pick("ar", "br").alias("from_row"), pick("bc", "ac").alias("to_col"), pick("br", "ar").alias("to_row"), F.round("length", 4).alias("length"))


DART_SQL = "dart AS (SELECT edge_id AS e, false AS back, source AS a, target AS b, distance AS w FROM edge UNION ALL SELECT edge_id, true, target, source, distance FROM edge)"
WALK_SQL = network.TWO_SQL + ", " + DART_SQL + """,
link AS (SELECT first AS s, second AS t FROM two UNION SELECT second, first FROM two),
lab(n, label) USING KEY (n) AS (SELECT edge_id, edge_id FROM edge
  UNION SELECT l.t, min(r.label) FROM lab r JOIN link l ON l.s = r.n JOIN recurring.lab o ON o.n = l.t WHERE r.label < o.label GROUP BY l.t),
open_end AS (SELECT label, min(struct_pack(a := d.a, e := d.e, back := d.back)) AS s FROM dart d JOIN lab ON lab.n = d.e WHERE d.a NOT IN (SELECT node_id FROM two) GROUP BY label),
start AS (SELECT label, s.e AS e, s.back AS back, false AS closed FROM open_end
          UNION ALL SELECT DISTINCT label, label, false, true FROM lab WHERE label NOT IN (SELECT label FROM open_end)),
walk(label, closed, s, seq, e, back, a, b, w, off) AS (
  SELECT t.label, t.closed, t.e, 0::bigint, d.e, d.back, d.a, d.b, d.w, 0::double FROM start t JOIN dart d ON d.e = t.e AND d.back = t.back
  UNION ALL SELECT k.label, k.closed, k.s, k.seq + 1, d.e, d.back, d.a, d.b, d.w, k.off + k.w FROM walk k JOIN two t ON t.node_id = k.b JOIN dart d ON d.a = k.b AND d.e <> k.e AND d.e <> k.s)"""
_doors = ", ".join(f"'{x}'" for x in DOORS)

QUERIES = {
    "corridor_order": Query(corridor_order, with_sql("+" + WALK_SQL + """
        SELECT label AS chain, seq, e AS edge_id, a, b, round(off, 4) AS "offset", count(*) OVER (PARTITION BY label) AS edges, closed FROM walk -- USING KEY""", "edge")),
    "merged_corridors": Query(merged_corridors, with_sql("+" + WALK_SQL + """,
        way AS (SELECT k.*, direction = 'both' OR (direction = 'forward') = NOT back AS ahead, direction = 'both' OR (direction = 'reverse') = NOT back AS behind, accessible FROM walk k JOIN edge ON edge_id = e)
        SELECT label AS chain, arg_min(a, seq) AS source, arg_max(b, seq) AS target, round(sum(w), 4) AS length,
               CASE WHEN bool_and(ahead) AND bool_and(behind) THEN 'both' WHEN bool_and(ahead) THEN 'forward' WHEN bool_and(behind) THEN 'reverse' ELSE 'none' END AS direction, bool_and(accessible) AS accessible
        FROM way GROUP BY label -- USING KEY""", "edge")),
    "edges_without_dead_ends": Query(edges_without_dead_ends, with_sql("+" + DART_SQL + f""",
        deg AS (SELECT a, count(*) AS n FROM dart WHERE a NOT IN (SELECT node_id FROM node WHERE node_type IN ({_doors})) GROUP BY a),
        gone(e, one) USING KEY (e) AS (
          SELECT DISTINCT d.e, 1 FROM dart d JOIN deg USING (a) WHERE n = 1
          UNION SELECT DISTINCT d.e, 1 FROM gone g JOIN dart h ON h.e = g.e JOIN dart d ON d.a = h.a JOIN deg ON deg.a = d.a
            JOIN (SELECT q.a, count(*) AS k FROM recurring.gone r JOIN dart q ON q.e = r.e GROUP BY q.a) c ON c.a = d.a
            LEFT JOIN recurring.gone o ON o.e = d.e WHERE o.e IS NULL AND deg.n - c.k = 1)
        SELECT edge_id, source, target, distance AS length FROM edge WHERE edge_id NOT IN (SELECT e FROM gone) -- USING KEY""", "edge")),
    "routing_links": Query(routing_links),
    "middle_cells": Query(middle_cells, with_sql("+" + coverage.CELLS_SQL + """,
        px AS (SELECT c.floor_id * 1000000 + row_no * 1000 + col AS id, c.floor_id, col, row_no, col BETWEEN 1 AND cols - 2 AND row_no BETWEEN 1 AND rows_no - 2 AS inside FROM open_cell c JOIN extent x ON x.floor_id = c.floor_id),
        nb AS (SELECT p.id, q.id AS o, k.bit FROM px p, (VALUES (0, -1, 1), (1, -1, 2), (1, 0, 4), (1, 1, 8), (0, 1, 16), (-1, 1, 32), (-1, 0, 64), (-1, -1, 128)) k(dx, dy, bit) JOIN px q ON q.floor_id = p.floor_id AND q.col = p.col + k.dx AND q.row_no = p.row_no + k.dy),
        rem(id, t) USING KEY (id) AS (
          SELECT -1::bigint, 0::bigint
          UNION SELECT c.id, w.k + 1 FROM (SELECT t AS k FROM rem WHERE id = -1) w
            JOIN (SELECT coalesce(max(t) FILTER (id >= 0), 0) AS last FROM recurring.rem) z ON w.k < 2 OR z.last >= w.k - 1
            JOIN (SELECT -1::bigint AS id, 0::bigint AS m
                  UNION ALL SELECT p.id, m FROM (SELECT nb.id, CAST(sum(bit) AS bigint) AS m FROM nb LEFT JOIN recurring.rem r ON r.id = nb.o WHERE r.id IS NULL GROUP BY nb.id) s JOIN px p ON p.id = s.id
                    LEFT JOIN recurring.rem o ON o.id = p.id WHERE o.id IS NULL AND p.inside) c
            ON c.id = -1 OR (bit_count(m) BETWEEN 2 AND 6 AND bit_count((255 - m) & ((m >> 1) | ((m & 1) << 7))) = 1
               AND CASE WHEN w.k % 2 = 0 THEN (m & 21) <> 21 AND (m & 84) <> 84 ELSE (m & 69) <> 69 AND (m & 81) <> 81 END))
        SELECT floor_id, col, row_no FROM px WHERE id NOT IN (SELECT id FROM rem) -- USING KEY""", *coverage.BASE)),
    "middle_lines": Query(middle_lines),
}
