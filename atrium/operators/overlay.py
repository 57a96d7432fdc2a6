"""Union, intersection and difference of polygons: all sides cut at their crossings, each piece labelled on both sides, pieces kept by a rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, rings, spatial
from atrium.sources.shared import step

#: Decimals of a metre that points are rounded to, so that crossings told by two sides are one point; and how near counts as on a side.
DECIMALS, NEAR = 9, 1e-7
LINE = ["cx", "cy", "dx", "dy"]


def oriented(sides: DataFrame) -> DataFrame:
    """Sides (floor_id, layer, polygon_id, ring, cx, cy, dx, dy) turned so that the inside is on their left: outlines counter-clockwise, holes clockwise.

    Points are rounded; sides without length are dropped.
    """
    sides = sides.select("floor_id", "layer", "polygon_id", "ring", *[F.round(c, DECIMALS).alias(c) for c in LINE])
    around = Window.partitionBy("floor_id", "layer", "polygon_id", "ring")
    area = F.sum(F.col("cx") * F.col("dy") - F.col("dx") * F.col("cy")).over(around)
    sides = sides.withColumn("turned", (area < 0) == (F.col("ring") == 0))
    ends = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(LINE, ("dx", "dy", "cx", "cy"), strict=True)]
    return sides.select("floor_id", "layer", "polygon_id", "ring", *ends).where("cx <> dx or cy <> dy")


def _meeting_points() -> Column:
    """Where sides a-e and c-d meet: their ends that lie on the other side, else where they cross."""
    c = F.col
    a, e, p, q = (c("ax"), c("ay")), (c("ex"), c("ey")), (c("cx"), c("cy")), (c("dx"), c("dy"))
    point = lambda x, y: F.struct(F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"))
    ends = F.array(*[F.when(G.segment_distance(*end, *other[0], *other[1]) < NEAR, point(*end)) for end, other in ((a, (p, q)), (e, (p, q)), (p, (a, e)), (q, (a, e)))])
    # The signed distances of a and e from the line c-d tell where between them it is crossed, and the same for c and d.
    off = lambda o, s, t: (t[0] - s[0]) * (o[1] - s[1]) - (t[1] - s[1]) * (o[0] - s[0])
    of_a, of_e, of_c, of_d = off(a, p, q), off(e, p, q), off(p, a, e), off(q, a, e)
    crosses = (of_a * of_e < 0) & (of_c * of_d < 0)
    t = of_a / F.when(crosses, of_a - of_e).otherwise(1.0)
    cross = F.when(crosses, point(a[0] + t * (e[0] - a[0]), a[1] + t * (e[1] - a[1])))
    ends = F.array_distinct(F.array_compact(ends))
    return F.when(F.size(ends) > 0, ends).otherwise(F.array_compact(F.array(cross)))


def pieces(sides: DataFrame) -> DataFrame:
    """(floor_id, layer, polygon_id, ax, ay, bx, by): sides (oriented) cut wherever any two of a floor meet."""
    sides = step(sides.withColumn("side", F.monotonically_increasing_id()), "sides")
    one = sides.select("floor_id", F.col("side").alias("one"), *[F.col(k).alias(n) for k, n in zip(LINE, ("ax", "ay", "bx", "by"), strict=True)])
    other = sides.select("floor_id", F.col("side").alias("other"), *LINE)
    met = floor._meeting(one, other, F.lit(NEAR)).where("one < other").select("one", "other", F.explode(_meeting_points()).alias("p"))
    cuts = met.select(F.explode(F.array("one", "other")).alias("side"), "p.x", "p.y")
    ends = sides.select("side", F.explode(F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")), F.struct(F.col("dx").alias("x"), F.col("dy").alias("y")))).alias("p")).select("side", "p.x", "p.y")
    points = cuts.unionByName(ends).distinct().join(sides, "side").withColumn("t", G.along(*[F.col(k) for k in ("x", "y", *LINE)]))
    w = Window.partitionBy("side").orderBy("t", "x", "y")
    out = points.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).where("bx is not null")
    return out.select("floor_id", "layer", "polygon_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


def _inside(points: DataFrame, sides: DataFrame) -> DataFrame:
    """(piece, layer, polygon_id) of the polygons that hold a point (piece, floor_id, x, y): by bins of their boxes, then by crossings of their sides."""
    c = F.col
    polygons = sides.groupBy("floor_id", "layer", "polygon_id").agg(F.collect_list(F.struct(*LINE)).alias("edges"), F.min(F.least("cx", "dx")).alias("x0"), F.min(F.least("cy", "dy")).alias("y0"), F.max(F.greatest("cx", "dx")).alias("x1"), F.max(F.greatest("cy", "dy")).alias("y1"))
    binned = spatial.spread(polygons, c("x0"), c("y0"), c("x1"), c("y1"), floor.BIN)
    near = floor._near(points, binned).where((c("x") >= c("x0")) & (c("x") <= c("x1")) & (c("y") >= c("y0")) & (c("y") <= c("y1")))
    crossed = lambda e: ((e["cy"] > c("y")) != (e["dy"] > c("y"))) & (c("x") < e["cx"] + (c("y") - e["cy"]) / F.when(e["dy"] == e["cy"], 1.0).otherwise(e["dy"] - e["cy"]) * (e["dx"] - e["cx"]))
    return near.where(F.size(F.filter("edges", crossed)) % 2 == 1).select("piece", "layer", "polygon_id")


def arrangement(sides: DataFrame) -> DataFrame:
    """Every piece once, with the number of polygons of layers a and b on its left and right: (floor_id, ax, ay, bx, by, la, lb, ra, rb).

    ``sides``: floor_id, layer ('a' or 'b'), polygon_id, ring, cx, cy, dx, dy; a polygon's rings must not cross each other.
    A polygon that has the piece on its boundary is on one side of it; any other holds the whole piece or nothing of it,
    which its middle tells.
    """
    sides = step(oriented(sides), "oriented")
    cut = pieces(sides)
    forth = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    turn = lambda a, b, name: F.when(forth, F.col(a)).otherwise(F.col(b)).alias(name)
    cut = cut.select("floor_id", "layer", "polygon_id", turn("ax", "bx", "ax"), turn("ay", "by", "ay"), turn("bx", "ax", "bx"), turn("by", "ay", "by"), F.when(forth, 1).otherwise(-1).alias("way"))
    own = cut.groupBy("floor_id", "ax", "ay", "bx", "by", "layer", "polygon_id").agg(F.sum("way").alias("way")).where("way <> 0")
    count = lambda layer, way: F.count_if((F.col("layer") == layer) & (F.col("way") * way > 0))
    own = own.groupBy("floor_id", "ax", "ay", "bx", "by").agg(count("a", 1).alias("la"), count("b", 1).alias("lb"), count("a", -1).alias("ra"), count("b", -1).alias("rb"), F.collect_list(F.struct("layer", "polygon_id")).alias("owners"))
    own = step(own.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    middles = own.select("piece", "owners", "floor_id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    held = _inside(middles.drop("owners"), sides).join(own.select("piece", "owners"), "piece").where(~F.array_contains("owners", F.struct("layer", "polygon_id")))
    held = held.groupBy("piece").agg(F.count_if(F.col("layer") == "a").alias("ha"), F.count_if(F.col("layer") == "b").alias("hb"))
    out = own.join(held, "piece", "left")
    sums = [(F.col(c) + F.coalesce(h, F.lit(0))).alias(c) for c, h in (("la", "ha"), ("lb", "hb"), ("ra", "ha"), ("rb", "hb"))]
    return out.select("floor_id", "ax", "ay", "bx", "by", *sums)


Rule = Callable[[Column, Column], Column]
UNION: Rule = lambda a, b: (a > 0) | (b > 0)
INTERSECTION: Rule = lambda a, b: (a > 0) & (b > 0)
DIFFERENCE: Rule = lambda a, b: (a > 0) & (b == 0)
OVERLAP: Rule = lambda a, b: a > 1


def outline(cut: DataFrame, rule: Rule) -> DataFrame:
    """The directed boundary (floor_id, ax, ay, bx, by), inside on the left, of what the rule takes by numbers of polygons of a and b."""
    left, right = rule(F.col("la"), F.col("lb")), rule(F.col("ra"), F.col("rb"))
    turn = lambda a, b, name: F.when(left, F.col(a)).otherwise(F.col(b)).alias(name)
    return cut.where(left != right).select("floor_id", turn("ax", "bx", "ax"), turn("ay", "by", "ay"), turn("bx", "ax", "bx"), turn("by", "ay", "by"))


def area(cut: DataFrame, rule: Rule, name: str = "area") -> DataFrame:
    """(floor_id, area) by the boundary alone; floors where nothing is taken are left out."""
    twice = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return outline(cut, rule).groupBy("floor_id").agg((F.sum(twice) / 2).alias(name))


def polygons(cut: DataFrame, rule: Rule) -> DataFrame:
    """Corners of the rings of what the rule takes: (floor_id, ring, seq, x, y); outlines counter-clockwise, holes clockwise."""
    return rings.turning_only(rings.link(outline(cut, rule)))


def nested(corners: DataFrame) -> DataFrame:
    """(floor_id, ring, outline, area): each hole with the smallest outline that holds it, each outline with itself."""
    size = step(rings.areas(corners), "areas")
    c = F.col
    around = corners.join(size.where("area > 0"), ["floor_id", "ring"])
    w = Window.partitionBy("floor_id", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda k: F.coalesce(F.lead(k).over(w), F.first(k).over(whole))
    sides = around.select("floor_id", F.lit("a").alias("layer"), c("ring").alias("polygon_id"), c("x").alias("cx"), c("y").alias("cy"), nxt("x").alias("dx"), nxt("y").alias("dy"))
    # A point a little to the left of a hole's longest side is on the ground around the hole, so the smallest outline around it is the hole's own.
    sides_of = corners.join(size.where("area < 0"), ["floor_id", "ring"]).select("floor_id", "ring", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"))
    length = G.distance(c("x"), c("y"), c("nx"), c("ny"))
    longest = sides_of.groupBy("floor_id", "ring").agg(F.max_by(F.struct("x", "y", "nx", "ny", length.alias("l")), length).alias("s")).select("floor_id", "ring", "s.*")
    back = 1e-6 / c("l")
    probe = longest.select(c("ring").alias("piece"), "floor_id", ((c("x") + c("nx")) / 2 - back * (c("ny") - c("y"))).alias("x"), ((c("y") + c("ny")) / 2 + back * (c("nx") - c("x"))).alias("y"))
    held = _inside(probe, sides).join(size.select(c("ring").alias("polygon_id"), "area"), "polygon_id").groupBy("piece").agg(F.min_by("polygon_id", "area").alias("outline"))
    out = size.join(held, size["ring"] == held["piece"], "left")
    return out.select("floor_id", "ring", F.when(c("area") > 0, c("ring")).otherwise(c("outline")).alias("outline"), "area")
