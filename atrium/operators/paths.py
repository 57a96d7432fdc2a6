"""A graph of nodes and edges from drawn paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.operators.order import first_kept
from atrium.sources.shared import step

# Metres between nodes along a path, metres within which a node is an earlier one; tolerances of crossings and of points on a segment.
SPACING, SNAP = 2.5, 0.15
CROSSING, ON = 1e-9, 1e-5
DECIMALS = 6


def segments(points: DataFrame) -> DataFrame:
    """(floor_id, seg, ax, ay, bx, by) of paths' points (floor_id, path_id, i, x, y, rotation), turned by ``rotation`` degrees about the middle of their path's box.

    ``seg`` is a struct (path_id, i), the order in which segments are looked at. Segments without length are left out.
    """
    whole = Window.partitionBy("floor_id", "path_id")
    middle = lambda c: (F.min(c).over(whole) + F.max(c).over(whole)) / 2
    x, y = G.rotated(F.col("x"), F.col("y"), middle("x"), middle("y"), F.col("rotation"))
    turned = points.select("floor_id", "path_id", "i", F.when(F.col("rotation") == 0, F.col("x")).otherwise(x).alias("ax"), F.when(F.col("rotation") == 0, F.col("y")).otherwise(y).alias("ay"))
    w = whole.orderBy("i")
    return turned.select("floor_id", F.struct("path_id", "i").alias("seg"), "ax", "ay", F.lead("ax").over(w).alias("bx"), F.lead("ay").over(w).alias("by")).where("bx is not null and (ax <> bx or ay <> by)")


def _on(px, py, ax, ay, bx, by):
    off = F.abs((py - ay) * (bx - ax) - (px - ax) * (by - ay))
    return (off < ON) & (px >= F.least(ax, bx) - ON) & (px <= F.greatest(ax, bx) + ON) & (py >= F.least(ay, by) - ON) & (py <= F.greatest(ay, by) + ON)


def crossings(lines: DataFrame) -> DataFrame:
    """(seg, x, y): where segments of a floor cross, for both, and their ends that lie on another where they do not cross."""
    c = F.col
    other = lines.select("floor_id", c("seg").alias("other"), c("ax").alias("cx"), c("ay").alias("cy"), c("bx").alias("dx"), c("by").alias("dy"))
    pairs = floor._meeting(lines, other, F.lit(1e-4)).where("seg < other")
    a, b, p, q = (c("ax"), c("ay")), (c("ex"), c("ey")), (c("cx"), c("cy")), (c("dx"), c("dy"))
    turn = (b[0] - a[0]) * (q[1] - p[1]) - (b[1] - a[1]) * (q[0] - p[0])
    slant = F.abs(turn) >= CROSSING
    safe = F.when(slant, turn).otherwise(1.0)
    t = ((p[0] - a[0]) * (q[1] - p[1]) - (p[1] - a[1]) * (q[0] - p[0])) / safe
    u = ((p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])) / safe
    within = lambda v: (v >= -CROSSING) & (v <= 1 + CROSSING)
    cross = slant & within(t) & within(u)
    cut = lambda who, x, y: F.struct(c(who).alias("seg"), x.alias("x"), y.alias("y"))
    x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
    ends = [F.when(_on(*end, *line[0], *line[1]), cut(who, *end)) for who, line, own in (("other", (p, q), (a, b)), ("seg", (a, b), (p, q))) for end in own]
    found = F.when(cross, F.array(cut("seg", x, y), cut("other", x, y))).otherwise(F.array_compact(F.array(*ends)))
    return pairs.select(F.explode(found).alias("k")).select("k.*")


def points_along(lines: DataFrame, spacing: float = SPACING) -> DataFrame:
    """(floor_id, seg, pos, x, y): each segment's ends and cuts, and points every ``spacing`` metres between them, in order. Cuts within a micrometre are one."""
    c = F.col
    ends = lines.select("seg", F.explode(F.array(F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y")))).alias("p")).select("seg", "p.*")
    cuts = ends.unionByName(crossings(lines)).groupBy("seg", F.round("x", DECIMALS), F.round("y", DECIMALS)).agg(F.min(F.struct("x", "y")).alias("p")).select("seg", "p.x", "p.y").join(lines, "seg")
    w = Window.partitionBy("seg").orderBy(G.distance(c("ax"), c("ay"), c("x"), c("y")), "x", "y")
    cuts = cuts.select("floor_id", "seg", F.row_number().over(w).alias("k"), "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    length = G.distance(c("x"), c("y"), c("nx"), c("ny"))
    n = F.coalesce(F.floor(length / spacing), F.lit(0)).cast("int")
    parts = F.filter(F.transform(F.sequence(F.lit(0), n), lambda j: F.struct(j.alias("j"), F.coalesce(j * spacing / F.when(length > 0, length).otherwise(1.0), F.lit(0.0)).alias("t"))), lambda s: (s["j"] == 0) | (s["t"] < 1))
    at = cuts.select("floor_id", "seg", "k", F.explode(parts).alias("s"), "x", "y", "nx", "ny")
    place = lambda a, b: F.when(c("s.j") == 0, c(a)).otherwise(c(a) + (c(b) - c(a)) * c("s.t"))
    return at.select("floor_id", "seg", F.struct("k", "s.j").alias("pos"), place("x", "nx").alias("x"), place("y", "ny").alias("y"))


def with_junctions(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``junction``: does the place lie on more than one segment of its floor?"""
    c = F.col
    shapes = lines.select("floor_id", c("seg").alias("other"), c("ax").alias("cx"), c("ay").alias("cy"), c("bx").alias("dx"), c("by").alias("dy"))
    shapes = spatial.spread(shapes, F.least("cx", "dx") - ON, F.least("cy", "dy") - ON, F.greatest("cx", "dx") + ON, F.greatest("cy", "dy") + ON, floor.BIN)
    places = points.select("floor_id", "x", "y").distinct()
    met = floor._near(places, shapes).where(_on(*[c(k) for k in ("x", "y", "cx", "cy", "dx", "dy")]))
    many = met.groupBy("floor_id", "x", "y").agg((F.count(F.lit(1)) > 1).alias("junction"))
    return points.join(many, ["floor_id", "x", "y"], "left").withColumn("junction", F.coalesce("junction", F.lit(False)))


def graph_of_paths(paths: DataFrame, spacing: float = SPACING, snap: float = SNAP) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, floor_id, x, y, node_type) and edges (floor_id, source, target, distance) of drawn paths.

    Paths are cut where they cross or touch; nodes stand at cuts and ends and every ``spacing`` metres between. In order of
    the segments, a place within ``snap`` metres of a node that is there already is that node (the nearest one). Nodes that
    follow each other on a segment have an edge, each pair one. A node is a junction if its place lies on two segments.
    ``node_id`` is a struct: the segment and the position that made the node. A place is settled once all earlier places near it
    are, so rounds are as many as the longest chain of such places.
    """
    lines = step(segments(paths), "segments")
    points = step(with_junctions(points_along(lines, spacing), lines), "points")
    order = F.struct("seg", "pos")
    places = step(points.groupBy("floor_id", "x", "y").agg(F.min(order).alias("id"), F.first("junction").alias("junction")), "places")
    discs = places.select("floor_id", F.col("id").alias("earlier"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = step(spatial.disc_join(places, discs, F.lit(snap), floor.BIN).where("earlier < id").select("id", "earlier", "dist"), "near")
    kept = first_kept(places, near)
    nodes = places.join(kept.where("kept").select("id"), "id")
    to = near.join(kept.where("kept").select(F.col("id").alias("earlier")), "earlier", "left_semi").join(kept.where("not kept").select("id"), "id", "left_semi")
    to = to.groupBy("id").agg(F.min(F.struct(F.round("dist", 9).alias("d"), "earlier")).alias("n")).select("id", F.col("n.earlier").alias("node_id"))
    of_place = places.join(to, "id", "left").select("floor_id", "x", "y", F.coalesce("node_id", "id").alias("node_id"))
    on = points.join(of_place, ["floor_id", "x", "y"])
    w = Window.partitionBy("seg").orderBy("pos")
    links = on.select("floor_id", F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("target")).where("target is not null and source <> target")
    links = links.select("floor_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    place = nodes.select(F.col("id").alias("node_id"), "x", "y")
    edges = links.join(place.select(F.col("node_id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay")), "source").join(place.select(F.col("node_id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by")), "target")
    edges = edges.select("floor_id", "source", "target", F.round(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), DECIMALS).alias("distance"))
    return nodes.select(F.col("id").alias("node_id"), "floor_id", "x", "y", F.when(F.col("junction"), "Junction").otherwise("Corridor").alias("node_type")), edges
