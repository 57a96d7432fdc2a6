"""Spatial tables derived from the star-schema tables.

Each rule is one SELECT in the dialect that Spark and DuckDB share, so both
sides of a check start from the same rows. Names in braces are input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Types of nodes and edges.
NODE_TYPES = ["Corridor", "Junction", "Entrance", "Exit", "Lift", "Escalator", "Stairs", "Room Entrance", "Landmark", "Custom"]
EDGE_TYPES = ["Walkway", "Lift Connection", "Stair Connection", "Escalator Connection", "Outdoor Path"]
POI_KINDS = ["Store", "Washroom", "Food", "Information", "Parking"]


def _pick(index: str, values: list[str]) -> str:
    return "CASE " + index + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


AREA_TYPES = ["Store", "Lift", "Stairs", "Escalator", "Wall", "Male Washroom"]
LABELS = ["Women washroom", "Lift lobby", "Electrical shaft", "Room 12", "Main atrium", "cold widget", "12 mm", "the", "Gents", "G123B"]

#: Rings of each shape: {shape: [[(x, y), ...], ...]}.
SHAPES = {
    0: [[(0, 0), (50, 0), (50, 20), (20, 20), (20, 40), (0, 40)]],
    1: [[(0, 0), (60, 0), (60, 60), (0, 60)], [(20, 20), (40, 20), (40, 40), (20, 40)]],
    2: [[(0, 0), (45, 5), (10, 40)]],
    3: [[(0, 0), (0, 30), (40, 30), (40, 0)]],
}
OUTLINES = {
    0: [[(-50, -50), (1065, -50), (1065, 800), (900, 800), (900, 1065), (-50, 1065)]],
    1: [[(-40, -40), (1050, -40), (1050, 790), (890, 790), (890, 1050), (-40, 1050)], [(400, 400), (500, 400), (500, 520), (400, 520)]],
}


def _shapes(shapes: dict[int, list[list[tuple[int, int]]]]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS shape, {r} AS ring, {i} AS i, {x} AS x, {y} AS y" for k, rings in shapes.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring))


RULES: dict[str, str] = {
    "node": f"""
        SELECT p_partkey AS node_id, CAST(floor(p_partkey / 400) AS bigint) AS floor_id,
               CAST((p_partkey % 20) * CAST(5.5 AS double) AS double) AS x,
               CAST(floor((p_partkey % 400) / 20) * CAST(5.5 AS double) AS double) AS y,
               {_pick('p_size % 10', NODE_TYPES)} AS node_type
        FROM {{part}}""",
    # Lattice edges with gaps, lifts from each storey to the next, and some faulty rows.
    "raw_edge": f"""
        SELECT edge_id, source, target, floor_id, distance, accessible, direction, {_pick('kind', EDGE_TYPES)} AS edge_type FROM (
        SELECT p_partkey * 4 AS edge_id, p_partkey AS source, p_partkey + 1 AS target, CAST(floor(p_partkey / 400) AS bigint) AS floor_id,
               CASE WHEN p_partkey % 97 = 5 THEN CAST(6.25 AS double) ELSE CAST(5.5 AS double) END AS distance, p_partkey % 13 <> 0 AS accessible,
               CASE WHEN p_partkey % 17 = 0 THEN 'forward' WHEN p_partkey % 19 = 0 THEN 'reverse' ELSE 'both' END AS direction,
               CASE WHEN p_partkey % 23 = 0 THEN 2 WHEN p_partkey % 29 = 0 THEN 3 WHEN p_partkey % 31 = 0 THEN 4 ELSE 0 END AS kind
        FROM {{part}} WHERE p_partkey % 20 < 19 AND (p_partkey * 13 + CAST(floor(p_partkey / 20) AS bigint) * 17 + CAST(floor(p_partkey / 7) AS bigint) * 3) % 10 >= 4
        UNION ALL
        SELECT p_partkey * 4 + 1, p_partkey, p_partkey + CASE WHEN p_partkey % 400 = 399 THEN 1000000 ELSE 20 END, CAST(floor(p_partkey / 400) AS bigint),
               CAST(5.5 AS double), p_partkey % 13 <> 0, CASE WHEN p_partkey % 17 = 0 THEN 'forward' WHEN p_partkey % 19 = 0 THEN 'reverse' ELSE 'both' END,
               CASE WHEN p_partkey % 23 = 0 THEN 2 WHEN p_partkey % 29 = 0 THEN 3 ELSE 0 END
        FROM {{part}} WHERE (p_partkey % 400 < 380 OR p_partkey % 400 = 399) AND (p_partkey * 13 + 5 + CAST(floor(p_partkey / 20) AS bigint) * 17 + CAST(floor(p_partkey / 7) AS bigint) * 3) % 10 >= 4
        UNION ALL
        SELECT p_partkey * 4 + 2, p_partkey, p_partkey + 400, CAST(floor(p_partkey / 400) AS bigint), CAST(4 AS double), true, 'both', 1 FROM {{part}} WHERE p_partkey % 400 = 45
        UNION ALL
        SELECT p_partkey * 4 + 3, p_partkey, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END, CAST(floor(p_partkey / 400) AS bigint), CAST(0 AS double), true, 'both', 0 FROM {{part}} WHERE p_partkey % 331 = 7
        ) e""",
    # Every 29th beacon stands at or near the one before it on its floor.
    "beacon": """
        SELECT c.c_custkey AS beacon_id, c.c_custkey % f.n AS floor_id,
               CAST((c.c_custkey - CASE WHEN c.c_custkey % 29 = 0 THEN f.n ELSE 0 END) * 37 % 2090 AS double) / CAST(20 AS double) + CASE WHEN c.c_custkey % 29 = 0 THEN CAST(c.c_custkey % 7 AS double) / CAST(10 AS double) ELSE CAST(0 AS double) END AS x,
               CAST((c.c_custkey - CASE WHEN c.c_custkey % 29 = 0 THEN f.n ELSE 0 END) * 53 % 2090 AS double) / CAST(20 AS double) AS y,
               c.c_acctbal > 0 AS enabled, CAST(5 + c.c_nationkey % 3 AS double) AS radius, CAST(7 + c.c_nationkey % 3 AS double) AS marginal,
               c.c_mktsegment AS strategy
        FROM {customer} c CROSS JOIN (SELECT CAST(floor(max(p_partkey) / 400) AS bigint) + 1 AS n FROM {part}) f""",
    "poi": f"""
        SELECT s.s_suppkey AS poi_id, s.s_name AS name, s.s_suppkey % f.n AS floor_id,
               CAST((s.s_suppkey * 61) % 2090 AS double) / CAST(20 AS double) AS x, CAST((s.s_suppkey * 29) % 2090 AS double) / CAST(20 AS double) AS y,
               {_pick('s.s_nationkey % 5', POI_KINDS)} AS kind
        FROM {{supplier}} s CROSS JOIN (SELECT CAST(floor(max(p_partkey) / 400) AS bigint) + 1 AS n FROM {{part}}) f""",
    "restricted": """
        SELECT p_partkey AS rect_id, CAST(floor(p_partkey / 400) AS bigint) AS floor_id,
               CAST((p_partkey * 17) % 100 AS double) + CAST(0.13 AS double) AS x0, CAST((p_partkey * 31) % 100 AS double) + CAST(0.13 AS double) AS y0,
               CAST((p_partkey * 17) % 100 AS double) + CAST(4.13 AS double) AS x1, CAST((p_partkey * 31) % 100 AS double) + CAST(3.13 AS double) AS y1
        FROM {part} WHERE p_partkey % 40 = 7""",
    "wall": """
        SELECT p_partkey AS wall_id, CAST(floor(p_partkey / 400) AS bigint) AS floor_id,
               CAST(p_partkey % 20 AS double) * CAST(5.5 AS double) + CAST(2.17 AS double) AS x,
               CAST(20.11 AS double) AS y0, CAST(61.19 AS double) AS y1, CAST(0.2 AS double) AS width
        FROM {part} WHERE p_partkey % 400 IN (203, 207, 211, 215, 219)""",
    # Rings of areas: L-shapes, squares with a hole, triangles and clockwise boxes; ring 0 is the outline. Lengths in tenths of a metre.
    "vertex": f"""
        SELECT p.floor_id, p.p_partkey AS polygon_id, CASE WHEN p.p_partkey % 3 = 0 THEN 'nonWalkable' ELSE 'restricted' END AS role, s.ring, s.i,
               CAST((p.p_partkey * 17) % 100 AS double) + CAST(s.x + 1.3 AS double) / CAST(10 AS double) AS x, CAST((p.p_partkey * 31) % 100 AS double) + CAST(s.y + 1.3 AS double) / CAST(10 AS double) AS y
        FROM (SELECT p_partkey, CAST(floor(p_partkey / 400) AS bigint) AS floor_id, CAST(floor(p_partkey / 40) AS bigint) % 4 AS shape FROM {{part}} WHERE p_partkey % 40 = 7) p
        JOIN ({_shapes(SHAPES)}) s ON s.shape = p.shape
        UNION ALL
        SELECT f.floor_id, 1000000000 + f.floor_id * 10 + s.shape, CASE WHEN s.shape = 0 THEN 'boundary' ELSE 'walkable' END, s.ring, s.i, CAST(s.x AS double) / CAST(10 AS double), CAST(s.y AS double) / CAST(10 AS double)
        FROM (SELECT DISTINCT CAST(floor(p_partkey / 400) AS bigint) AS floor_id FROM {{part}}) f CROSS JOIN ({_shapes(OUTLINES)}) s
        WHERE (s.shape = 0 AND f.floor_id % 5 <> 4) OR (s.shape = 1 AND f.floor_id % 3 <> 2)""",
    # Walls and walkable paths, piece by piece.
    "capsule": """
        SELECT p_partkey AS path_id, s.seg, CAST(floor(p_partkey / 400) AS bigint) AS floor_id, 'wall' AS kind, CAST(0.2 AS double) AS width,
               CAST(p_partkey % 20 AS double) * CAST(5.5 AS double) + CAST(2.17 AS double) AS ax, CASE WHEN s.seg = 0 THEN CAST(20.11 AS double) ELSE CAST(41.19 AS double) END AS ay,
               CAST(p_partkey % 20 AS double) * CAST(5.5 AS double) + CASE WHEN s.seg = 0 THEN CAST(2.17 AS double) ELSE CAST(6.67 AS double) END AS bx, CASE WHEN s.seg = 0 THEN CAST(41.19 AS double) ELSE CAST(47.29 AS double) END AS by_
        FROM {part} CROSS JOIN (SELECT 0 AS seg UNION ALL SELECT 1) s WHERE p_partkey % 400 IN (203, 207, 211, 215, 219)
        UNION ALL
        SELECT p_partkey, s.seg, CAST(floor(p_partkey / 400) AS bigint), 'path', CAST(2 AS double), CASE WHEN s.seg = 0 THEN CAST(0 AS double) ELSE CAST(99 AS double) END, CAST(55 AS double),
               CAST(99 AS double), CASE WHEN s.seg = 0 THEN CAST(55 AS double) ELSE CAST(82.5 AS double) END
        FROM {part} CROSS JOIN (SELECT 0 AS seg UNION ALL SELECT 1) s WHERE p_partkey % 400 = 60 AND CAST(floor(p_partkey / 400) AS bigint) % 2 = 0""",
    # Annotated areas (axis-parallel, some of them overlapping) and the labels read from a plan.
    "area": f"""
        SELECT p_partkey AS area_id, CAST(floor(p_partkey / 400) AS bigint) AS floor_id, {_pick('p_size % 6', AREA_TYPES)} AS kind, p_size % 4 = 0 AS needs_review,
               CASE p_partkey % 5 WHEN 0 THEN concat('Detected area ', CAST(p_partkey AS varchar(20))) WHEN 1 THEN concat('Room ', CAST(p_partkey % 90 AS varchar(20))) WHEN 2 THEN p_name WHEN 3 THEN concat('A', CAST(100 + p_partkey % 900 AS varchar(20))) END AS name,
               CAST(p_partkey % 20 AS double) * CAST(5.5 AS double) + CAST(0.25 AS double) AS x0, CAST(floor((p_partkey % 400) / 20) AS double) * CAST(5.5 AS double) + CAST(0.25 AS double) AS y0,
               CAST(p_partkey % 20 AS double) * CAST(5.5 AS double) + CAST(2.25 + p_size % 7 AS double) AS x1, CAST(floor((p_partkey % 400) / 20) AS double) * CAST(5.5 AS double) + CAST(3.25 + p_partkey % 4 AS double) AS y1
        FROM {{part}} WHERE p_partkey % 2 = 1""",
    "label": f"""
        SELECT o.o_orderkey AS label_id, o.o_orderkey % f.n AS floor_id, CAST((o.o_orderkey * 7919) % 1100 AS double) / CAST(10 AS double) AS x, CAST((o.o_orderkey * 104729) % 1100 AS double) / CAST(10 AS double) AS y,
               {_pick('o.o_custkey % 10', LABELS)} AS text, CASE WHEN o.o_orderkey % 3 = 0 THEN 'pdf-text' ELSE 'ocr' END AS source, CAST(o.o_custkey % 100 AS double) AS confidence
        FROM {{orders}} o CROSS JOIN (SELECT CAST(floor(max(p_partkey) / 400) AS bigint) + 1 AS n FROM {{part}}) f WHERE o.o_orderkey % 3 < 2""",
    # Edits of beacons in the order they were made.
    "command": """
        SELECT e.event_id AS seq, e.ts, e.event_id * 7 % c.n AS beacon_id, CASE e.event_id % 8 WHEN 0 THEN 'lock' WHEN 1 THEN 'move' WHEN 2 THEN 'unlock' WHEN 3 THEN 'delete' WHEN 4 THEN 'disable' WHEN 5 THEN 'enable' WHEN 6 THEN 'duplicate' ELSE 'move' END AS action,
               CAST(e.event_id % 1040 AS double) / CAST(10 AS double) AS x, CAST(e.event_id * 3 % 1040 AS double) / CAST(10 AS double) AS y
        FROM {events} e CROSS JOIN (SELECT max(c_custkey) + 1 AS n FROM {customer}) c""",
    # Drawn paths of four points: along, across and aslant, some of them turned as a whole.
    "walk_path": """
        SELECT s.s_suppkey % f.n AS floor_id, s.s_suppkey AS path_id, k.i, CASE WHEN s.s_suppkey % 5 = 0 THEN CAST(30 AS double) ELSE CAST(0 AS double) END AS rotation,
               CASE k.i WHEN 0 THEN CAST(s.s_suppkey * 7 % 20 AS double) * CAST(5.5 AS double) WHEN 3 THEN CAST(s.s_suppkey * 17 % 1000 AS double) / CAST(10 AS double) ELSE CAST((s.s_suppkey * 11 + 3) % 20 AS double) * CAST(5.5 AS double) END AS x,
               CASE k.i WHEN 2 THEN CAST((s.s_suppkey * 13 + 5) % 20 AS double) * CAST(5.5 AS double) WHEN 3 THEN CAST(s.s_suppkey * 29 % 1000 AS double) / CAST(10 AS double) ELSE CAST(s.s_suppkey * 3 % 20 AS double) * CAST(5.5 AS double) END AS y
        FROM {supplier} s CROSS JOIN (SELECT CAST(floor(max(p_partkey) / 400) AS bigint) + 1 AS n FROM {part}) f CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    # What users of the plan change of the beacons: moved, switched off, or moved and switched on.
    "edit": """
        SELECT e.event_id AS seq, e.user_id % c.n AS beacon_id, CASE WHEN e.event_id % 3 <> 1 THEN CAST(e.event_id % 1040 AS double) / CAST(10 AS double) END AS x,
               CASE WHEN e.event_id % 3 <> 1 THEN CAST(e.event_id * 3 % 1040 AS double) / CAST(10 AS double) END AS y, CASE e.event_id % 3 WHEN 1 THEN false WHEN 2 THEN true END AS enabled
        FROM {events} e CROSS JOIN (SELECT max(c_custkey) + 1 AS n FROM {customer}) c""",
    "floor": "SELECT DISTINCT CAST(floor(p_partkey / 400) AS bigint) AS floor_id FROM {part}",
}
TABLES = ("part", "customer", "supplier", "orders", "events", "documents", "embeddings", "labels", "nation", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; ``edge`` is ``raw_edge`` of positive length whose two different ends exist."""
    if name == "edge":
        edges, nodes = derived(spark, sf_dir, "raw_edge").where("source <> target and distance > 0"), derived(spark, sf_dir, "node").select("node_id").hint("merge")
        for end in ("source", "target"):
            edges = edges.join(nodes.withColumnRenamed("node_id", end), end, "left_semi")
        return edges.select("edge_id", "source", "target", "floor_id", "distance", "accessible", "direction", "edge_type")
    rule = RULES[name]
    return spark.sql(rule, **{t: base(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in rule})


def with_sql(body: str, *names: str) -> str:
    """A DuckDB query with the named derived tables in front."""
    rules = {n: RULES[n].format(**{t: t for t in TABLES}) for n in RULES}
    rules["edge"] = "SELECT * FROM raw_edge WHERE source <> target AND distance > 0 AND source IN (SELECT node_id FROM node) AND target IN (SELECT node_id FROM node)"
    needed = list(dict.fromkeys((["raw_edge", "node"] if "edge" in names else []) + list(names)))
    recursive = "RECURSIVE " if "USING KEY" in body else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({rules[n]})" for n in needed) + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")
