"""Directed boundary edges linked into rings, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.sources.shared import forget, step


def successors(edges: DataFrame) -> DataFrame:
    """(edge, next) of directed edges (floor_id, edge, ax, ay, bx, by) with the inside on their left.

    At an edge's end the next is the first one that leaves, turning clockwise from the way back: it bounds the same
    corner of the inside, so areas that touch in one point get rings of their own. One window per point over its edges.
    """
    out = edges.select("floor_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("angle"), "edge", F.lit(True).alias("leaves"))
    back = edges.select("floor_id", F.col("bx").alias("x"), F.col("by").alias("y"), F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")).alias("angle"), "edge", F.lit(False).alias("leaves"))
    at = Window.partitionBy("floor_id", "x", "y").orderBy(F.desc("angle"), "leaves", "edge")
    leaving = F.when(F.col("leaves"), F.col("edge"))
    turn = F.first(leaving, ignorenulls=True).over(at.rowsBetween(1, Window.unboundedFollowing))
    around = F.first(leaving, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.unionByName(back).withColumn("next", F.coalesce(turn, around)).where("not leaves and next is not null").select("edge", "next")


def ranked_cycles(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(edge, ring, seq, length) of links (edge, next) that form cycles: the least edge names the ring and comes first.

    Each round doubles how far an edge sees ahead: it knows the least edge among those and how many steps off that is.
    When a round changes nothing, all edges have seen their whole ring: as many rounds as the logarithm of the longest.
    """
    now = step(links.select("edge", "next", F.col("edge").alias("least"), F.lit(0).cast("long").alias("away"), F.lit(1).cast("long").alias("far")), "chain")
    for _ in range(most_rounds):
        ahead = now.select(F.col("edge").alias("next"), F.col("next").alias("then"), F.col("least").alias("least2"), F.col("away").alias("away2"))
        both = now.join(ahead, "next")
        better = F.col("least2") < F.col("least")
        then = step(both.select("edge", F.col("then").alias("next"), F.least("least", "least2").alias("least"), F.when(better, F.col("away2") + F.col("far")).otherwise(F.col("away")).alias("away"), (F.col("far") * 2).alias("far"), better.alias("changed")), "chain")
        done = then.where("changed").isEmpty()
        forget(now)
        now = then.drop("changed")
        if done:
            break
    else:
        raise RuntimeError("links are no cycles")
    sizes = now.groupBy("least").agg((F.max("away") + 1).alias("length"))
    out = now.join(sizes, "least")
    return out.select("edge", F.col("least").alias("ring"), F.when(F.col("away") == 0, F.lit(0)).otherwise(F.col("length") - F.col("away")).cast("long").alias("seq"), "length")


def link(edges: DataFrame) -> DataFrame:
    """Corners of the rings of directed edges (floor_id, ax, ay, bx, by): (floor_id, ring, seq, x, y), rings in their order.

    Edges are numbered here; a ring's number is its least. Corners that lie on a straight line between their neighbours stay.
    """
    edges = step(edges.select("floor_id", "ax", "ay", "bx", "by", F.monotonically_increasing_id().alias("edge")), "ring-edges")
    cycles = ranked_cycles(successors(edges))
    return edges.join(cycles, "edge").select("floor_id", "ring", "seq", F.col("ax").alias("x"), F.col("ay").alias("y"))


def mask_sides(cells: DataFrame) -> DataFrame:
    """Directed sides (floor_id, ax, ay, bx, by) of a mask of cells (floor_id, col, row_no), the mask on their left: sides that only one cell has."""
    c, r = F.col("col"), F.col("row_no")
    side = lambda ax, ay, bx, by: F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    around = F.array(side(c, r, c + 1, r), side(c + 1, r, c + 1, r + 1), side(c + 1, r + 1, c, r + 1), side(c, r + 1, c, r))
    sides = cells.select("floor_id", "col", "row_no").distinct().select("floor_id", F.explode(around).alias("s"))
    ends = [F.least("s.ax", "s.bx").alias("x0"), F.least("s.ay", "s.by").alias("y0"), (F.col("s.ax") != F.col("s.bx")).alias("level")]
    return sides.groupBy("floor_id", *ends).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")).where("n = 1").select("floor_id", *[F.col(f"s.{k}").cast("double").alias(k) for k in ("ax", "ay", "bx", "by")])


def turning_only(corners: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Corners (floor_id, ring, seq, x, y) at which a ring turns, numbered anew."""
    w = Window.partitionBy("floor_id", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    ux, uy, vx, vy = F.col("x") - before("x"), F.col("y") - before("y"), after("x") - F.col("x"), after("y") - F.col("y")
    turn = F.abs(ux * vy - uy * vx) > tolerance * F.greatest(F.lit(1.0), F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))
    kept = corners.withColumn("turns", turn | (ux * vx + uy * vy < 0)).where("turns").drop("turns")
    return kept.withColumn("seq", F.row_number().over(w).cast("long") - 1)


def areas(corners: DataFrame) -> DataFrame:
    """(floor_id, ring, area): signed, positive for outlines (counter-clockwise)."""
    w = Window.partitionBy("floor_id", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    return corners.withColumn("s", (F.col("x") * ny - nx * F.col("y")) / 2).groupBy("floor_id", "ring").agg(F.sum("s").alias("area"))
