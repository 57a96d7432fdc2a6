"""Polygons, labels and their checks; export rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.plans import coverage
from atrium.plans.query import Query
from atrium.sources.derive import base, derived, with_sql
from atrium.sources.shared import step

# Keywords of categories in the order they are tried, patterns that make a name valid, words that do not.
KEYWORDS = [
    ("Female Washroom", "women|ladies|female"), ("Male Washroom", "men|gents|male"), ("Lift", "lift|elevator"), ("Stairs", "stair|steps"), ("Escalator", "escalator"), ("Travelator", "travelator"), ("Ramp", "ramp"),
    ("Restricted Area", "staff|service|store room|electrical|shaft|duct|plant|storage"), ("Non Walkable", "atrium|void|water|tracks|pit"), ("Washroom", "wc|toilet|restroom|washroom"),
]
NAME_PATTERN = r"(?i)\b[A-Z]\d{3}[A-Z]?\b|\b\dK\d{1,3}[A-Z]?\b|\b[GS]L-\d{2}\b|^(Room|Ward|Gate|Office|Classroom|Counter|Exhibit|Enclosure|Lift) [A-Z0-9-]+$"
NOT_NAMES = ["the", "and", "for", "area", "floor", "north", "south", "east", "west"]
NOT_PATTERN = r"(?i)\b(extent|wide fire corridor|scale|legend)\b|\d\s*(mm|m²|sqm)\b"
DICTIONARY = ["reception", "emergency", "pharmacy", "cafeteria", "library", "laboratory", "security", "information"]
TEXT_SOURCES = ["pdf-text", "svg-text", "cad-text"]


def rings(spark, d) -> DataFrame:
    """Areas' rings as arrays of points in their order: (floor_id, polygon_id, role, ring, points)."""
    v = derived(spark, d, "vertex")
    return v.groupBy("floor_id", "polygon_id", "role", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def polygon_measurements(spark, d) -> DataFrame:
    """Area less holes, and the length of outline and holes, of each polygon."""
    r = rings(spark, d).withColumn("area", F.abs(G.ring_area(F.col("points")))).withColumn("length", G.perimeter(F.col("points")))
    return r.groupBy("polygon_id", "role").agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))), 6).alias("area"), F.round(F.sum("length"), 6).alias("perimeter"), F.count(F.lit(1)).alias("rings"))


def ring_orientation(spark, d) -> DataFrame:
    return rings(spark, d).select("polygon_id", "ring", F.when(G.ring_area(F.col("points")) > 0, "ccw").otherwise("cw").alias("orientation"))


def polygon_bounds(spark, d) -> DataFrame:
    """Bounding boxes, and each polygon's first corner turned by 30 degrees about the box's middle, snapped to 0.25 m."""
    b = derived(spark, d, "vertex").groupBy("polygon_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.min_by(F.struct("x", "y"), F.struct("ring", "i")).alias("p"))
    x, y = G.rotated(F.col("p.x"), F.col("p.y"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.lit(30.0))
    return b.select("polygon_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(x, 6).alias("turned_x"), F.round(y, 6).alias("turned_y"), G.snap(F.round(x, 6), 0.25).alias("snapped_x"))


def ring_self_intersections(spark, d) -> DataFrame:
    """Rings of five points taken from neighbouring beacons: do two sides that are not neighbours meet, also along one line?"""
    w = Window.partitionBy("ring_id").orderBy("beacon_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = derived(spark, d, "beacon").withColumn("ring_id", F.floor(F.col("beacon_id") / 5))
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    sides = p.select("ring_id", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(whole).alias("n"), F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by")).where("n = 5").drop("n")
    other = sides.select("ring_id", *[F.col(c).alias(k) for c, k in (("i", "j"), ("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by", "dy"))])
    pairs = sides.join(other, "ring_id").where("j > i + 1 and not (i = 1 and j = 5)")
    cut = F.size(floor.line_cuts(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")])) > 0
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    apart = F.least(*[G.segment_distance(*[F.col(c) for c in k]) for k in (("cx", "cy", "ax", "ay", "bx", "by"), ("dx", "dy", "ax", "ay", "bx", "by"), ("ax", "ay", "cx", "cy", "dx", "dy"), ("bx", "by", "cx", "cy", "dx", "dy"))])
    meet = F.when(F.abs(rx * sy - ry * sx) > G.EPS, cut).otherwise(apart < G.EPS)
    return pairs.groupBy("ring_id").agg(F.max(meet).alias("crosses"))


def geometry_roles(spark, d) -> DataFrame:
    """What a drawing object counts as: restricted before blocked before its own role; plain areas are not walkable."""
    p = base(spark, d, "part")
    kinds = ["room", "polygon", "rectangle", "walkableArea", "restrictedArea", "nonWalkableArea", "wall", "walkablePath", "buildingBoundary", "text"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % 10 + 1)
    o = p.select("p_partkey", kind.alias("kind"), F.when(F.col("p_partkey") % 7 == 0, "restrictedAreas").otherwise("rooms").alias("layer"), F.when(F.col("p_partkey") % 11 == 0, "Lift").when(F.col("p_partkey") % 13 == 0, "Restricted Area").alias("category"))
    area = F.col("kind").isin(kinds[:6])
    restricted = (F.col("kind") == "restrictedArea") | (area & (((F.col("layer") == "restrictedAreas") & (F.col("kind") != "nonWalkableArea")) | F.coalesce(F.col("category") == "Restricted Area", F.lit(False))))
    blocked = area & F.coalesce(F.col("category") == "Lift", F.lit(False))
    role = F.when(restricted, "restrictedArea").when(blocked, "nonWalkableArea").when(F.col("kind").isin("room", "polygon", "rectangle"), "nonWalkableArea").otherwise(F.col("kind"))
    return o.select("p_partkey", role.alias("role")).where("role <> 'text'")


def geo_projection(spark, d) -> DataFrame:
    lon, lat = G.local_to_lonlat(F.col("x"), F.col("y"), 77.09, 28.49)
    return derived(spark, d, "node").select("node_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def similarity_fit(spark, d) -> DataFrame:
    """u = a*x - b*y + tx, v = b*x + a*y + ty by least squares, per floor, from areas' middles to their reference's, with the largest residual."""
    areas = derived(spark, d, "area").select("area_id", "floor_id", "kind", "x0", "y0", "x1", "y1")
    mid = lambda df, x, y: df.select("area_id", "floor_id", ((F.col("x0") + F.col("x1")) / 2).alias(x), ((F.col("y0") + F.col("y1")) / 2).alias(y))
    p = mid(areas, "x", "y").join(mid(_reference(areas), "u", "v").drop("floor_id"), "area_id")
    m = p.groupBy("floor_id").agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "u", "v")])
    q = p.join(m, "floor_id")  # one row per floor
    dx, dy, du, dv = (F.col(c) - F.col(f"m{c}") for c in ("x", "y", "u", "v"))
    s = q.groupBy("floor_id").agg(F.sum(dx * du + dy * dv).alias("sa"), F.sum(dx * dv - dy * du).alias("sb"), F.sum(dx * dx + dy * dy).alias("ss"))
    fit = s.select("floor_id", (F.col("sa") / F.col("ss")).alias("a"), (F.col("sb") / F.col("ss")).alias("b"))
    r = q.join(fit, "floor_id").withColumn("ru", du - F.col("a") * dx + F.col("b") * dy).withColumn("rv", dv - F.col("b") * dx - F.col("a") * dy)
    return r.groupBy("floor_id").agg(F.round(F.max("a"), 6).alias("a"), F.round(F.max("b"), 6).alias("b"), F.round(F.max(F.sqrt(F.col("ru") * F.col("ru") + F.col("rv") * F.col("rv"))), 4).alias("max_residual"))


def named_well(name, repeated):
    """Is a text a name? By pattern, or if mostly letters and either repeated on the plan or holding a known word."""
    text = F.trim(name)
    bad = name.isNull() | (F.length(text) < 3) | name.rlike(r"(?i)^Detected\b") | F.lower(text).isin(NOT_NAMES) | name.rlike(NOT_PATTERN)
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", "")) / F.length(name)
    known = F.exists(F.split(F.lower(name), "[^a-z]+"), lambda w: w.isin(DICTIONARY))
    return F.when(bad, False).when(name.rlike(NAME_PATTERN), True).otherwise((letters > 0.65) & (repeated | known))


def repeated_labels(spark, d) -> DataFrame:
    return derived(spark, d, "label").groupBy(F.lower(F.trim("text")).alias("low")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("low")


def name_validity(spark, d) -> DataFrame:
    a = derived(spark, d, "area").select("area_id", "name", F.lower("name").alias("low"))
    a = a.join(repeated_labels(spark, d).withColumn("again", F.lit(True)), "low", "left")
    return a.select("area_id", named_well(F.col("name"), F.coalesce("again", F.lit(False))).alias("valid"))


def category_of(text, current):
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b({words})"), k) for k, words in KEYWORDS], current)


def category_by_keyword(spark, d) -> DataFrame:
    return derived(spark, d, "label").select("label_id", category_of(F.col("text"), F.lit("Other")).alias("category"))


def near_labels(spark, d, within: float = 0.5) -> DataFrame:
    """Labels within half a metre of an area, ranked: plan text before recognised text, then confidence, then text."""
    c = F.col
    a = spatial.spread(derived(spark, d, "area"), c("x0") - within, c("y0") - within, c("x1") + within, c("y1") + within, 10.0)
    l = derived(spark, d, "label").select(c("floor_id").alias("f"), "label_id", "x", "y", "text", "source", "confidence").withColumn("kx", F.floor(c("x") / 10.0).cast("int")).withColumn("ky", F.floor(c("y") / 10.0).cast("int"))
    dx, dy = F.greatest(c("x0") - c("x"), c("x") - c("x1"), F.lit(0.0)), F.greatest(c("y0") - c("y"), c("y") - c("y1"), F.lit(0.0))
    pairs = a.join(l, (c("floor_id") == c("f")) & (c("bx") == c("kx")) & (c("by") == c("ky")) & (F.sqrt(dx * dx + dy * dy) <= within + G.EPS))
    w = Window.partitionBy("area_id").orderBy((~c("source").isin(TEXT_SOURCES)).cast("int"), c("confidence").desc(), "text", "label_id")
    return pairs.select("area_id", "label_id", "text", "kind", "name", F.row_number().over(w).cast("long").alias("rank"))


def label_of_area(spark, d) -> DataFrame:
    """The texts whose place lies in an area, in reading order."""
    inside = near_labels(spark, d, 0.0).join(derived(spark, d, "label").select("label_id", "x", "y"), "label_id")
    return inside.groupBy("area_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "label_id", "text"))), lambda t: t["text"]), " ").alias("texts"), F.count(F.lit(1)).alias("labels"))


def naming(spark, d) -> DataFrame:
    """Name and type of each area: the first valid name among its ranked labels and its own; washrooms are numbered."""
    c = F.col
    again = repeated_labels(spark, d)
    own = derived(spark, d, "area").select("area_id", "kind", c("name").alias("text"), F.lit(1_000_000_000).cast("long").alias("rank"))
    all_names = near_labels(spark, d).select("area_id", "kind", F.trim("text").alias("text"), "rank").unionByName(own)
    judged = all_names.withColumn("low", F.lower("text")).join(again.withColumn("again", F.lit(True)), "low", "left")
    judged = judged.withColumn("valid", named_well(c("text"), F.coalesce("again", F.lit(False))))
    out = judged.groupBy("area_id").agg(F.min(F.when(c("valid"), F.struct("rank", "text"))).alias("best"), F.max("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(F.when(c("text").isNotNull(), F.struct("rank", "text")))), lambda t: t["text"]).alias("texts"))
    out = out.withColumn("kind", category_of(F.array_join("texts", " "), c("kind")))
    n = F.row_number().over(Window.partitionBy("kind").orderBy("area_id"))
    washroom = c("kind").isin("Male Washroom", "Female Washroom")
    return out.select("area_id", "kind", F.when(washroom, F.concat("kind", F.lit("-"), n.cast("string"))).otherwise(c("best.text")).alias("name"))


def _overlaps(a: DataFrame, b: DataFrame, keep) -> DataFrame:
    """Pairs of boxes (floor_id, area_id, x0..y1) whose insides meet, with the common area: by bins, each pair from one bin."""
    c = F.col
    left = spatial.spread(a, c("x0"), c("y0"), c("x1"), c("y1"), 10.0)
    right = b.select(c("floor_id").alias("f"), c("area_id").alias("other_id"), *[c(k).alias(f"o{k}") for k in ("x0", "y0", "x1", "y1")])
    right = spatial.spread(right, c("ox0"), c("oy0"), c("ox1"), c("oy1"), 10.0).withColumnsRenamed({"bx": "kx", "by": "ky"})
    x0, y0, x1, y1 = F.greatest("x0", "ox0"), F.greatest("y0", "oy0"), F.least("x1", "ox1"), F.least("y1", "oy1")
    on = (c("floor_id") == c("f")) & (c("bx") == c("kx")) & (c("by") == c("ky")) & (x0 < x1) & (y0 < y1) & (c("bx") == F.floor(x0 / 10.0)) & (c("by") == F.floor(y0 / 10.0)) & keep
    size = lambda p: (c(f"{p}x1") - c(f"{p}x0")) * (c(f"{p}y1") - c(f"{p}y0"))
    return left.join(right, on).select("floor_id", "area_id", "other_id", ((x1 - x0) * (y1 - y0)).alias("common"), size("").alias("size"), size("o").alias("other_size"))


def area_overlaps(spark, d) -> DataFrame:
    """Pairs of areas that share more than 0.1 square metres and more than 0.5 % of the smaller."""
    a = derived(spark, d, "area").select("floor_id", "area_id", "x0", "y0", "x1", "y1")
    o = _overlaps(a, a, F.col("area_id") < F.col("other_id")).where(F.col("common") > F.greatest(F.lit(0.1), 0.005 * F.least("size", "other_size")))
    return o.select("area_id", "other_id", F.round("common", 6).alias("common"))


def missing_counterparts(spark, d) -> DataFrame:
    """Lifts, stairs and escalators without one of their kind within 10 m on a neighbouring floor."""
    c = F.col
    a = derived(spark, d, "area").where("kind in ('Lift', 'Stairs', 'Escalator')").select("area_id", "floor_id", "kind", ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y"))
    others = a.select(F.explode(F.array(c("floor_id") - 1, c("floor_id") + 1)).alias("floor_id"), c("kind").alias("other_kind"), c("x").alias("cx"), c("y").alias("cy"))
    met = spatial.disc_join(a, others, F.lit(10.0), 10.0).where("kind = other_kind").select("area_id").distinct()
    return a.join(met, "area_id", "left_anti").select("area_id", "floor_id", "kind")


def _reference(a: DataFrame) -> DataFrame:
    """The same areas as another hand drew them: moved a little, every ninth left out, every seventh of another type."""
    shift = F.col("area_id") % 4 * 0.25
    kind = F.when(F.col("area_id") % 7 == 0, "Store").otherwise(F.col("kind"))
    return a.where("area_id % 9 <> 4").select("area_id", "floor_id", kind.alias("kind"), (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")


def detection_matches(spark, d) -> DataFrame:
    """One-to-one pairs of detected and reference areas with IoU of 0.5 or more, best first.

    A pair is taken when it is the best left of both its areas; pairs of taken
    areas go, and the rest is looked at again. That gives what taking pairs one
    by one in falling order gives, in a few rounds.
    """
    a = derived(spark, d, "area").select("area_id", "floor_id", "kind", "x0", "y0", "x1", "y1")
    o = _overlaps(a.drop("kind"), _reference(a).drop("kind"), F.lit(True))
    left = step(o.select("area_id", "other_id", F.round(F.col("common") / (F.col("size") + F.col("other_size") - F.col("common")), 9).alias("iou")).where("iou >= 0.5"), "pairs")
    taken = []
    while not left.isEmpty():
        rank = F.struct("iou", "area_id", "other_id")
        best = left.withColumn("a", F.max(rank).over(Window.partitionBy("area_id"))).withColumn("b", F.max(rank).over(Window.partitionBy("other_id")))
        now = step(best.where((F.col("a") == rank) & (F.col("b") == rank)).select("area_id", "other_id", "iou"), "taken")
        taken.append(now)
        left = step(left.join(now.select("area_id"), "area_id", "left_anti").join(now.select("other_id"), "other_id", "left_anti"), "pairs")
    pairs = reduce(DataFrame.unionByName, taken) if taken else left
    return pairs.join(a.select("area_id", "kind"), "area_id").join(_reference(a).select(F.col("area_id").alias("other_id"), F.col("kind").alias("other_kind")), "other_id").select("area_id", "other_id", "iou", "kind", "other_kind")


def type_confusion(spark, d) -> DataFrame:
    return detection_matches(spark, d).groupBy("kind", "other_kind").agg(F.count(F.lit(1)).alias("n"))


def detection_scores(spark, d) -> DataFrame:
    """Precision and recall of each type among the matched areas."""
    a = derived(spark, d, "area").select("area_id", "floor_id", "kind", "x0", "y0", "x1", "y1")
    one = lambda df, k, name: df.groupBy(F.col(k).alias("kind")).agg(F.count(F.lit(1)).alias(name))
    right = one(detection_matches(spark, d).where("kind = other_kind"), "kind", "right")
    out = one(a, "kind", "mine").join(one(_reference(a), "kind", "reference"), "kind", "full").join(right, "kind", "left").na.fill(0)
    return out.select("kind", "mine", "reference", F.round(F.col("right") / F.greatest("mine", F.lit(1)), 6).alias("precision"), F.round(F.col("right") / F.greatest("reference", F.lit(1)), 6).alias("recall"))


def annotation_stats(spark, d) -> DataFrame:
    """Per type: number, median size, share without a name and share to be reviewed."""
    a = derived(spark, d, "area").withColumn("size", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    share = lambda cond: F.round(F.avg(cond.cast("double")), 6)
    return a.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("size", 0.5), 6).alias("median_size"), share(F.col("name").isNull()).alias("nameless"), share(F.col("needs_review")).alias("review"))


def annotation_rule_violations(spark, d) -> DataFrame:
    """One row per broken rule, over areas and rings."""
    a = derived(spark, d, "area").withColumn("size", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    rule = lambda name, rows, key: rows.select(F.lit(name).alias("rule"), F.col(key).cast("long").alias("id"))
    entry = F.col("kind").isin("Store", "Lift", "Male Washroom")
    corners = a.select("area_id", "floor_id", F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(x + y).alias("at")) for x in ("x0", "x1") for y in ("y0", "y1")])).alias("p")).select("area_id", "floor_id", "p.*")
    outside = floor.conflicts(corners, ["area_id", "at"], coverage.geometry(spark, d)).where("conflict_off_path in ('outside-building', 'missing-building-boundary')").select("area_id").distinct()
    walls = a.groupBy("floor_id").agg(F.avg((F.col("kind") == "Wall").cast("double")).alias("share"), F.avg(F.col("needs_review").cast("double")).alias("review"))
    return reduce(DataFrame.unionByName, [
        rule("ring-orientation", ring_orientation(spark, d).where("ring = 0 and orientation = 'cw'"), "polygon_id"),
        rule("overlap", area_overlaps(spark, d), "area_id"),
        rule("outside-boundary", outside, "area_id"),
        rule("unusual-size", a.where(entry & ((F.col("size") < 3) | ((F.col("kind") == "Lift") & (F.col("size") > 30)))), "area_id"),
        rule("no-counterpart", missing_counterparts(spark, d), "area_id"),
        rule("name-not-valid", name_validity(spark, d).where("not valid"), "area_id"),
        rule("many-walls", walls.where("share > 0.15"), "floor_id"),
        rule("many-reviews", walls.where("review > 0.25"), "floor_id"),
    ])


def label_flatten(spark, d) -> DataFrame:
    """Turns as lines, lines as words: one label per line with its words of letters, joined again."""
    c = base(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.filter(F.split("line", " "), lambda w: w.rlike("[A-Za-z]"))
    return c.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.concat_ws(" ", words).alias("label")).where("label <> ''")


def sequential_names(spark, d) -> DataFrame:
    w = Window.partitionBy("floor_id", "kind").orderBy("poi_id")
    n = F.row_number().over(w)
    padded = F.when(n >= 1000, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    return derived(spark, d, "poi").select("poi_id", F.concat("kind", F.lit(" "), padded).alias("label"))


def floor_geojson(spark, d) -> DataFrame:
    """Areas as GeoJSON features: outlines counter-clockwise, holes clockwise, both closed; walls as one ring per piece."""
    r = rings(spark, d).withColumn("points", F.when((G.ring_area(F.col("points")) < 0) == (F.col("ring") == 0), F.reverse("points")).otherwise(F.col("points")))
    line = lambda ps: F.concat(F.lit("["), F.array_join(F.transform(F.concat(ps, F.slice(ps, 1, 1)), lambda p: F.format_string("[%.2f,%.2f]", p["x"], p["y"])), ","), F.lit("]"))
    p = r.withColumn("text", line(F.col("points"))).groupBy("polygon_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", "text"))), lambda t: t["text"]), ",").alias("rings"))
    head = F.concat(F.lit('{"type":"Feature","properties":{"id":'), F.col("polygon_id").cast("string"), F.lit(',"role":"'), F.col("role"), F.lit('"},"geometry":{"type":"Polygon","coordinates":['))
    return p.select("polygon_id", F.concat(head, "rings", F.lit("]}}")).alias("feature"))


def _named_sql(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in NOT_NAMES)
    return f"""(CASE WHEN {c} IS NULL OR length(trim({c})) < 3 OR regexp_matches({c}, '(?i)^Detected\\b') OR lower(trim({c})) IN ({words}) OR regexp_matches({c}, '{NOT_PATTERN}') THEN false
        WHEN regexp_matches({c}, '{NAME_PATTERN}') THEN true ELSE length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) / length({c}) > 0.65 AND (lower({c}) IN (SELECT low FROM again) OR regexp_matches(lower({c}), '\\b({"|".join(DICTIONARY)})\\b')) END)"""


def _category_sql(text: str, current: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i)\\b({words})') THEN '{k}'" for k, words in KEYWORDS) + f" ELSE {current} END"


def _apart_sql(px, py, ax, ay, bx, by) -> str:
    t = f"coalesce(greatest(0, least(1, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay})) / nullif(power({bx}-{ax},2)+power({by}-{ay},2), 0))), 0)"
    return f"sqrt(power({px}-{ax}-{t}*({bx}-{ax}),2)+power({py}-{ay}-{t}*({by}-{ay}),2))"


VALID_SQL = "again AS (SELECT lower(trim(text)) AS low FROM label GROUP BY 1 HAVING count(*) > 1)"
NEAR_SQL = """near AS (SELECT area_id, label_id, text, kind, name, row_number() OVER (PARTITION BY area_id ORDER BY CASE WHEN source IN ('pdf-text', 'svg-text', 'cad-text') THEN 0 ELSE 1 END, confidence DESC, text, label_id) AS rank
        FROM area a JOIN label l ON l.floor_id = a.floor_id AND sqrt(power(greatest(x0 - x, x - x1, 0), 2) + power(greatest(y0 - y, y - y1, 0), 2)) <= 0.5 + 1e-8)"""
OVERLAP_SQL = """met AS (SELECT a.area_id, b.area_id AS other_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, (a.x1-a.x0)*(a.y1-a.y0) AS s, (b.x1-b.x0)*(b.y1-b.y0) AS t
        FROM area a JOIN area b ON a.floor_id = b.floor_id AND a.area_id < b.area_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
        over AS (SELECT * FROM met WHERE common > greatest(0.1, 0.005 * least(s, t)))"""
COUNTER_SQL = """vert AS (SELECT area_id, floor_id, kind, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM area WHERE kind IN ('Lift', 'Stairs', 'Escalator')),
        lonely AS (SELECT area_id, floor_id, kind FROM vert a WHERE NOT EXISTS (SELECT 1 FROM vert b WHERE b.kind = a.kind AND abs(b.floor_id - a.floor_id) = 1 AND sqrt(power(a.x-b.x, 2) + power(a.y-b.y, 2)) <= 10 + 1e-8))"""

QUERIES = {
    "polygon_measurements": Query(polygon_measurements, with_sql("+" + floor.SHAPES_SQL.lstrip() + """, r AS (SELECT polygon_id, role, ring, abs(sum(cx*dy-dx*cy)/2) AS area, sum(sqrt(power(dx-cx,2)+power(dy-cy,2))) AS length FROM side GROUP BY ALL)
        SELECT polygon_id, role, round(sum(CASE WHEN ring = 0 THEN area ELSE -area END), 6) AS area, round(sum(length), 6) AS perimeter, count(*) AS rings FROM r GROUP BY polygon_id, role""", "vertex", "capsule")),
    "ring_orientation": Query(ring_orientation, with_sql("+" + floor.SHAPES_SQL.lstrip() + " SELECT polygon_id, ring, CASE WHEN sum(cx*dy-dx*cy) > 0 THEN 'ccw' ELSE 'cw' END AS orientation FROM side GROUP BY polygon_id, ring", "vertex", "capsule")),
    "polygon_bounds": Query(polygon_bounds, with_sql("""+b AS (SELECT polygon_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(struct_pack(r := ring, i := i, x := x, y := y)) AS p FROM vertex GROUP BY polygon_id),
        t AS (SELECT *, (x0+x1)/2 + (p.x-(x0+x1)/2)*cos(radians(30.0)) - (p.y-(y0+y1)/2)*sin(radians(30.0)) AS tx, (y0+y1)/2 + (p.x-(x0+x1)/2)*sin(radians(30.0)) + (p.y-(y0+y1)/2)*cos(radians(30.0)) AS ty FROM b)
        SELECT polygon_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(tx, 6) AS turned_x, round(ty, 6) AS turned_y, floor(round(tx, 6) / 0.25 + 0.5) * 0.25 AS snapped_x FROM t""", "vertex")),
    "ring_self_intersections": Query(ring_self_intersections, with_sql("""+p AS (SELECT CAST(floor(beacon_id / 5) AS bigint) AS ring_id, beacon_id, x, y FROM beacon),
        e AS (SELECT ring_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY ring_id) AS n, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM p WINDOW w AS (PARTITION BY ring_id ORDER BY beacon_id)),
        q AS (SELECT a.*, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.by_ AS dy, (a.bx-a.ax)*(b.by_-b.ay)-(a.by_-a.ay)*(b.bx-b.ax) AS den FROM e a JOIN e b ON a.ring_id = b.ring_id AND b.i > a.i + 1 AND NOT (a.i = 1 AND b.i = 5) WHERE a.n = 5),
        k AS (SELECT ring_id, CASE WHEN abs(den) > 1e-8 THEN ((cx-ax)*(dy-cy)-(cy-ay)*(dx-cx))/den BETWEEN 0 AND 1 AND ((cx-ax)*(by_-ay)-(cy-ay)*(bx-ax))/den BETWEEN 0 AND 1 ELSE least(""" + ", ".join(_apart_sql(*k) for k in (("cx", "cy", "ax", "ay", "bx", "by_"), ("dx", "dy", "ax", "ay", "bx", "by_"), ("ax", "ay", "cx", "cy", "dx", "dy"), ("bx", "by_", "cx", "cy", "dx", "dy"))) + """) < 1e-8 END AS meet FROM q)
        SELECT ring_id, bool_or(meet) AS crosses FROM k GROUP BY ring_id""", "beacon")),
    "geometry_roles": Query(geometry_roles, """WITH o AS (SELECT p_partkey, ['room', 'polygon', 'rectangle', 'walkableArea', 'restrictedArea', 'nonWalkableArea', 'wall', 'walkablePath', 'buildingBoundary', 'text'][p_size % 10 + 1] AS kind, p_size % 10 < 6 AS area,
          p_partkey % 7 = 0 AS layered, p_partkey % 11 = 0 AS lift, p_partkey % 13 = 0 AND p_partkey % 11 <> 0 AS barred FROM part)
        SELECT p_partkey, CASE WHEN kind = 'restrictedArea' OR (area AND ((layered AND kind <> 'nonWalkableArea') OR barred)) THEN 'restrictedArea' WHEN area AND lift THEN 'nonWalkableArea' WHEN kind IN ('room', 'polygon', 'rectangle') THEN 'nonWalkableArea' ELSE kind END AS role FROM o WHERE kind <> 'text'"""),
    "geo_projection": Query(geo_projection, with_sql("SELECT node_id, round((77.09::double + degrees(x / (6378137.0::double * cos(radians(28.49::double)))) + 540) % 360 - 180, 6) AS lon, round(28.49::double + degrees(y / 6378137.0::double), 6) AS lat FROM node", "node")),
    "similarity_fit": Query(similarity_fit, with_sql("""+p AS (SELECT floor_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y, (x0+x1)/2 + area_id % 4 * 0.25::double AS u, (y0+y1)/2 AS v FROM area WHERE area_id % 9 <> 4),
        c AS (SELECT floor_id, x - avg(x) OVER f AS dx, y - avg(y) OVER f AS dy, u - avg(u) OVER f AS du, v - avg(v) OVER f AS dv FROM p WINDOW f AS (PARTITION BY floor_id)),
        s AS (SELECT floor_id, sum(dx*du+dy*dv) / sum(dx*dx+dy*dy) AS a, sum(dx*dv-dy*du) / sum(dx*dx+dy*dy) AS b FROM c GROUP BY floor_id)
        SELECT floor_id, round(max(a), 6) AS a, round(max(b), 6) AS b, round(max(sqrt(power(du - a*dx + b*dy, 2) + power(dv - b*dx - a*dy, 2))), 4) AS max_residual FROM c JOIN s USING (floor_id) GROUP BY floor_id""", "area")),
    "name_validity": Query(name_validity, with_sql(f"+{VALID_SQL} SELECT area_id, {_named_sql('name')} AS valid FROM area", "area", "label")),
    "category_by_keyword": Query(category_by_keyword, with_sql(f"SELECT label_id, {_category_sql('text', chr(39) + 'Other' + chr(39))} AS category FROM label", "label")),
    "near_labels": Query(near_labels, with_sql(f"+{NEAR_SQL} SELECT * FROM near", "area", "label")),
    "label_of_area": Query(label_of_area, with_sql("""SELECT area_id, string_agg(text, ' ' ORDER BY y, x, label_id) AS texts, count(*) AS labels FROM area a JOIN label l ON l.floor_id = a.floor_id AND l.x BETWEEN x0 - 1e-8 AND x1 + 1e-8 AND l.y BETWEEN y0 - 1e-8 AND y1 + 1e-8 GROUP BY area_id""", "area", "label")),
    "naming": Query(naming, with_sql(f"""+{VALID_SQL}, {NEAR_SQL}, c AS (SELECT area_id, kind, trim(text) AS text, rank FROM near UNION ALL SELECT area_id, kind, name, 1000000000 FROM area),
        j AS (SELECT area_id, max(kind) AS kind, min(struct_pack(r := rank, t := text)) FILTER ({_named_sql('text')}) AS best, string_agg(text, ' ' ORDER BY rank) AS texts FROM c GROUP BY area_id),
        k AS (SELECT area_id, best, {_category_sql('texts', 'kind')} AS kind FROM j)
        SELECT area_id, kind, CASE WHEN kind IN ('Male Washroom', 'Female Washroom') THEN kind || '-' || row_number() OVER (PARTITION BY kind ORDER BY area_id) ELSE best.t END AS name FROM k""", "area", "label")),
    "area_overlaps": Query(area_overlaps, with_sql(f"+{OVERLAP_SQL} SELECT area_id, other_id, round(common, 6) AS common FROM over", "area")),
    "missing_counterparts": Query(missing_counterparts, with_sql(f"+{COUNTER_SQL} SELECT * FROM lonely", "area")),
    "annotation_stats": Query(annotation_stats, with_sql("SELECT kind, count(*) AS n, round(quantile_cont((x1-x0)*(y1-y0), 0.5), 6) AS median_size, round(avg(CASE WHEN name IS NULL THEN 1.0::double ELSE 0 END), 6) AS nameless, round(avg(CASE WHEN needs_review THEN 1.0::double ELSE 0 END), 6) AS review FROM area GROUP BY kind", "area")),
    "annotation_rule_violations": Query(annotation_rule_violations, with_sql(f"""+{floor.SHAPES_SQL.lstrip()}, {VALID_SQL}, {OVERLAP_SQL}, {COUNTER_SQL},
        pt AS (SELECT area_id * 4 + k AS pid, floor_id, CASE WHEN k < 2 THEN x0 ELSE x1 END AS x, CASE WHEN k % 2 = 0 THEN y0 ELSE y1 END AS y FROM area, range(4) r(k)),{floor.conflict_sql("pt", "cf")},
        w AS (SELECT floor_id, avg(CASE WHEN kind = 'Wall' THEN 1.0::double ELSE 0 END) AS share, avg(CASE WHEN needs_review THEN 1.0::double ELSE 0 END) AS review FROM area GROUP BY floor_id)
        SELECT 'ring-orientation' AS rule, polygon_id AS id FROM side WHERE ring = 0 GROUP BY polygon_id HAVING sum(cx*dy-dx*cy) <= 0
        UNION ALL SELECT 'overlap', area_id FROM over UNION ALL SELECT 'outside-boundary', id FROM (SELECT DISTINCT CAST(floor(pid / 4) AS bigint) AS id FROM cf WHERE conflict_off_path IN ('outside-building', 'missing-building-boundary'))
        UNION ALL SELECT 'unusual-size', area_id FROM area WHERE kind IN ('Store', 'Lift', 'Male Washroom') AND ((x1-x0)*(y1-y0) < 3 OR (kind = 'Lift' AND (x1-x0)*(y1-y0) > 30))
        UNION ALL SELECT 'no-counterpart', area_id FROM lonely UNION ALL SELECT 'name-not-valid', area_id FROM area WHERE NOT {_named_sql('name')}
        UNION ALL SELECT 'many-walls', floor_id FROM w WHERE share > 0.15 UNION ALL SELECT 'many-reviews', floor_id FROM w WHERE review > 0.25""", "area", "label", "vertex", "capsule")),
    "detection_matches": Query(detection_matches),
    "type_confusion": Query(type_confusion),
    "detection_scores": Query(detection_scores),
    "label_flatten": Query(label_flatten, """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)
        SELECT * FROM (SELECT conv_id, turn, i, array_to_string(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '[A-Za-z]')), ' ') AS label FROM l) WHERE label <> ''"""),
    "sequential_names": Query(sequential_names, with_sql("SELECT poi_id, kind || ' ' || CASE WHEN n >= 1000 THEN n::varchar ELSE lpad(n::varchar, 3, '0') END AS label FROM (SELECT *, row_number() OVER (PARTITION BY floor_id, kind ORDER BY poi_id) AS n FROM poi)", "poi")),
    "floor_geojson": Query(floor_geojson, with_sql("+" + floor.SHAPES_SQL.lstrip() + """, g AS (SELECT polygon_id, role, ring, (sum(cx*dy-dx*cy) < 0) = (ring = 0) AS turn, list(struct_pack(x := cx, y := cy) ORDER BY i) AS ps FROM side GROUP BY polygon_id, role, ring),
        h AS (SELECT polygon_id, role, ring, CASE WHEN turn THEN list_reverse(ps) ELSE ps END AS ps FROM g),
        t AS (SELECT polygon_id, role, ring, '[' || array_to_string(list_transform(list_append(ps, ps[1]), lambda p: printf('[%.2f,%.2f]', p.x, p.y)), ',') || ']' AS text FROM h)
        SELECT polygon_id, '{"type":"Feature","properties":{"id":' || polygon_id || ',"role":"' || role || '"},"geometry":{"type":"Polygon","coordinates":[' || string_agg(text, ',' ORDER BY ring) || ']}}' AS feature FROM t GROUP BY polygon_id, role""", "vertex", "capsule")),
}
