"""Edits of a deployment, versions, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.operators import floor, spatial
from atrium.plans import coverage, placement
from atrium.plans.query import Query
from atrium.sources.derive import base, derived, with_sql
from atrium.sources.shared import shared_dir, step
from atrium.streaming import changes

# The fields of a beacon's export row, in their order.
CSV_FIELDS = ["id", "floorId", "type", "profileId", "enabled", "locked", "worldX", "worldY", "installationType", "mountingHeight", "orientation", "coverageRadius", "reliableRadius", "marginalRadius", "edgeId", "edgeOffset", "nodeId", "referenceDistance", "placementStrategy", "placementRole", "installationStatus", "notes"]
CELL = 0.5
MOST_CELLS = 40_000


def command_outcomes(spark, d) -> DataFrame:
    """Is each edit accepted? A locked beacon is neither moved nor deleted; after its deletion a beacon takes no edit."""
    w = Window.partitionBy("beacon_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = derived(spark, d, "command")
    c = c.withColumn("locked", F.coalesce(F.last(F.when(F.col("action").isin("lock", "unlock"), F.col("action") == "lock"), ignorenulls=True).over(before), F.lit(False)))
    gone = F.coalesce(F.max(((F.col("action") == "delete") & ~F.col("locked")).cast("int")).over(before), F.lit(0)) == 1
    verdict = F.when(gone, "no-such-beacon").when(F.col("locked") & F.col("action").isin("move", "delete"), "locked").otherwise("accepted")
    return c.select("seq", "beacon_id", "action", "x", "y", verdict.alias("verdict"))


def deployment_after_commands(spark, d) -> DataFrame:
    """The beacons after all accepted edits: last place, state and origin; copies get ids of their own."""
    w = Window.partitionBy("beacon_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ok = command_outcomes(spark, d).where("verdict = 'accepted'")
    last = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("seq")))
    a = F.col("action")
    state = ok.groupBy("beacon_id").agg(last(a == "move", F.struct("x", "y")).alias("at"), last(a.isin("lock", "unlock"), a).alias("lock"), last(a.isin("enable", "disable"), a).alias("on"), F.max((a == "delete").cast("int")).alias("deleted"))
    b = derived(spark, d, "beacon").select("beacon_id", "floor_id", "x", "y", "enabled")
    now = b.join(state, "beacon_id", "left").where("coalesce(deleted, 0) = 0")
    kept = now.select("beacon_id", "floor_id", F.coalesce("at.x", "x").alias("x"), F.coalesce("at.y", "y").alias("y"), F.coalesce(F.col("on") == "enable", F.col("enabled")).alias("enabled"), F.coalesce(F.col("lock") == "lock", F.lit(False)).alias("locked"), F.when(F.col("at").isNotNull(), "manual").otherwise("automatic").alias("origin"))
    moved = ok.withColumn("at", F.last(F.when(a == "move", F.struct("x", "y")), ignorenulls=True).over(w)).withColumn("on", F.last(F.when(a.isin("enable", "disable"), a), ignorenulls=True).over(w)).where("action = 'duplicate'")
    copies = moved.select("seq", "beacon_id", "at", "on").join(b, "beacon_id").select((F.lit(1_000_000_000) + F.col("seq")).alias("beacon_id"), "floor_id", F.coalesce("at.x", "x").alias("x"), F.coalesce("at.y", "y").alias("y"), F.coalesce(F.col("on") == "enable", F.col("enabled")).alias("enabled"), F.lit(False).alias("locked"), F.lit("manual").alias("origin"))
    return kept.unionByName(copies)


def invalid_after_commands(spark, d) -> DataFrame:
    """Beacons that stand in a conflict after the edits: what a check of the deployment reports and a restore drops if they are automatic and unlocked."""
    b = deployment_after_commands(spark, d)
    out = floor.conflicts(b, ["beacon_id"], coverage.geometry(spark, d)).where("conflict_off_path is not null")
    return out.select("beacon_id", F.col("conflict_off_path").alias("conflict"), ((F.col("origin") == "automatic") & ~F.col("locked")).alias("dropped"))


def affected_cells(spark, d) -> DataFrame:
    """Cells within the marginal radius of a beacon's old or new place, for beacons that edits moved, removed, switched or copied."""
    key = ["floor_id", "beacon_id"]
    old = derived(spark, d, "beacon").select(*key, "x", "y", "enabled")
    radius = derived(spark, d, "beacon").select("beacon_id", "marginal")
    new = step(deployment_after_commands(spark, d).select(*key, "x", "y", "enabled"), "edited")
    changed = old.exceptAll(new).unionByName(new.exceptAll(old)).where("enabled").join(radius, "beacon_id", "left").withColumn("marginal", F.coalesce("marginal", F.lit(9.0)))
    discs = changed.select("floor_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "marginal")
    cells = coverage.open_cells(spark, d, coverage.geometry(spark, d))
    return spatial.disc_join(cells, discs, F.col("marginal"), coverage.BIN).groupBy("floor_id").agg(F.count_distinct("col", "row_no").alias("cells"))


def coverage_resolution(spark, d) -> DataFrame:
    """Cell size of each floor: half a metre, larger where that would make more than 40,000 cells; and the size of the analysis raster."""
    v = derived(spark, d, "vertex").groupBy("floor_id").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    cells = F.ceil(F.col("w") / CELL) * F.ceil(F.col("h") / CELL)
    factor = F.greatest(F.lit(1.0), F.sqrt(cells / float(MOST_CELLS)))
    width, height = F.col("w") * 20, F.col("h") * 20
    ratio = F.least(F.lit(1.0), 800 / F.greatest(width, height), F.sqrt(F.lit(400_000.0) / (width * height)))
    px = lambda c: F.greatest(F.lit(3), F.floor(c * ratio)).cast("long")
    return v.select("floor_id", F.round(CELL * factor, 6).alias("cell"), px(width).alias("raster_width"), px(height).alias("raster_height"))


def _number(c):
    """As text without an idle .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def beacon_csv(spark, d) -> DataFrame:
    """All 22 fields of each beacon, quoted, quotes doubled, texts that a spreadsheet would run made plain; line 0 is the header. Lines end in CRLF."""
    b = derived(spark, d, "beacon").join(placement.beacon_nearest_edge(spark, d).select("beacon_id", "edge_id", "dist"), "beacon_id", "left")
    text = lambda c: F.when(c.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    notes = F.when(F.col("beacon_id") % 5 == 0, F.concat(F.lit('=SUM("'), F.col("beacon_id").cast("string"), F.lit('")'))).when(F.col("beacon_id") % 5 == 1, '-check "wall", left').otherwise("")
    values = {
        "id": F.concat(F.lit("beacon-"), F.when(F.col("beacon_id") >= 1000, F.col("beacon_id").cast("string")).otherwise(F.lpad(F.col("beacon_id").cast("string"), 3, "0"))),
        "floorId": F.concat(F.lit("floor-"), F.col("floor_id").cast("string")), "type": F.lit("Navigation"), "enabled": F.col("enabled").cast("string"), "locked": F.lit("false"),
        "worldX": _number(F.round("x", 2)), "worldY": _number(F.round("y", 2)), "coverageRadius": _number(F.col("radius")), "reliableRadius": _number(F.col("radius")), "marginalRadius": _number(F.col("marginal")),
        "edgeId": F.coalesce(F.col("edge_id").cast("string"), F.lit("")), "referenceDistance": F.coalesce(_number(F.round("dist", 2)), F.lit("")), "placementStrategy": text(F.col("strategy")), "notes": text(notes),
    }
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.concat_ws(",", *[cell(values.get(f, F.lit(""))) for f in CSV_FIELDS]), F.lit("\r\n"))
    head = ",".join(f'"{f}"' for f in CSV_FIELDS) + "\r\n"
    first = derived(spark, d, "floor").agg(F.lit(-1).cast("long").alias("beacon_id"), F.lit(head).alias("line"))
    return b.select("beacon_id", line.alias("line")).unionByName(first)


def deployment_document(spark, d) -> DataFrame:
    """One JSON document per floor: units, counts and its beacons in order."""
    b = derived(spark, d, "beacon").groupBy("floor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("beacon_id").alias("id"), "enabled", F.col("strategy").alias("placementStrategy")))).alias("beacons"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("floor_id").alias("floorId"), F.lit("metres").alias("units"), F.lit(False).alias("isRFSimulation"), F.size("beacons").alias("beaconCount"), "beacons")
    return b.select("floor_id", F.to_json(body).alias("document"))


def document_beacons(spark, d) -> DataFrame:
    """Reads the documents back: one row per beacon."""
    kind = "struct<schemaVersion:int,floorId:bigint,beacons:array<struct<id:bigint,enabled:boolean,placementStrategy:string>>>"
    doc = deployment_document(spark, d).select(F.from_json("document", kind).alias("j"))
    return doc.select(F.col("j.floorId").alias("floor_id"), F.inline("j.beacons")).withColumnsRenamed({"id": "beacon_id", "placementStrategy": "strategy"})


def quality_report(spark, d) -> DataFrame:
    """Per floor: status of the deployment, coverage without its cells, and inputs."""
    cov = coverage.floor_coverage_summary(spark, d)
    beacons = derived(spark, d, "beacon").groupBy("floor_id").agg(F.count(F.lit(1)).alias("beacons"))
    nodes = derived(spark, d, "node").groupBy("floor_id").agg(F.count(F.lit(1)).alias("nodes"))
    out = derived(spark, d, "floor").join(cov, "floor_id", "left").join(beacons, "floor_id", "left").join(nodes, "floor_id", "left")
    status = F.when(F.col("cells").isNull(), "analysis-failed").when(F.coalesce("beacons", F.lit(0)) > 0, "draft-generated").otherwise("not-generated")
    return out.select("floor_id", status.alias("status"), "coverage_pct", F.coalesce("beacons", F.lit(0)).alias("beacons"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def input_signature(spark, d) -> DataFrame:
    """Per floor a hash of its beacons in order, and whether it equals the one after the edits."""
    sign = lambda b: b.groupBy("floor_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beacon_id", "x", "y"))), lambda r: F.concat_ws(":", r["beacon_id"].cast("string"), F.format_string("%.2f", r["x"]), F.format_string("%.2f", r["y"]))), ","), 256).alias("s"))
    a, z = sign(derived(spark, d, "beacon")), sign(deployment_after_commands(spark, d)).withColumnRenamed("s", "t")
    return a.join(z, "floor_id", "left").select("floor_id", F.col("s").alias("signature"), F.coalesce(F.col("s") == F.col("t"), F.lit(False)).alias("unchanged"))


def content_hash_lookup(spark, d) -> DataFrame:
    """Pages whose content is that of an earlier page: matched by SHA-256."""
    p = base(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))
    first = p.groupBy("sha").agg(F.min("page_id").alias("reference"))
    return p.join(first, "sha").select("page_id", "reference", (F.col("page_id") != F.col("reference")).alias("known"))


def preserved_and_generated(spark, d) -> DataFrame:
    """A new plan: locked beacons stay, generated stations nearer than 0.25 m to one of them are left out."""
    kept = step(deployment_after_commands(spark, d).where("locked").select("beacon_id", "floor_id", "x", "y"), "kept")
    made = derived(spark, d, "beacon").where("enabled").select("beacon_id", "floor_id", "x", "y")
    discs = kept.select("floor_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = spatial.disc_join(made, discs, F.lit(0.25), 2.0).select("beacon_id").distinct()
    fresh = made.join(near, "beacon_id", "left_anti").join(kept.select("beacon_id"), "beacon_id", "left_anti")
    return kept.select("beacon_id", F.lit("kept").alias("origin")).unionByName(fresh.select("beacon_id", F.lit("generated").alias("origin")))


def stream_state_changes(spark, d) -> DataFrame:
    return changes.drained(changes.state_changes(changes.source(spark, d, "events")), "changes")


def stream_last_event(spark, d) -> DataFrame:
    e = changes.source(spark, d, "events").select("user_id", "event_id", "event_type")
    return changes.kept_current(e, ["user_id"], "event_id", f"{shared_dir(spark).rstrip('/')}/current-{uuid.uuid4().hex}")


OUTCOME_SQL = """
lockings AS (SELECT *, coalesce(last_value(CASE action WHEN 'lock' THEN true WHEN 'unlock' THEN false END IGNORE NULLS) OVER w, false) AS locked FROM command WINDOW w AS (PARTITION BY beacon_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goings AS (SELECT *, coalesce(max(CASE WHEN action = 'delete' AND NOT locked THEN 1 ELSE 0 END) OVER (PARTITION BY beacon_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM lockings),
outcome AS (SELECT seq, beacon_id, action, x, y, CASE WHEN gone = 1 THEN 'no-such-beacon' WHEN locked AND action IN ('move', 'delete') THEN 'locked' ELSE 'accepted' END AS verdict FROM goings),
ok AS (SELECT * FROM outcome WHERE verdict = 'accepted'),
state AS (SELECT beacon_id, max_by(struct_pack(x := x, y := y), seq) FILTER (action = 'move') AS at_, max_by(action, seq) FILTER (action IN ('lock', 'unlock')) AS lock_, max_by(action, seq) FILTER (action IN ('enable', 'disable')) AS on_, bool_or(action = 'delete') AS deleted FROM ok GROUP BY beacon_id),
running AS (SELECT *, last_value(CASE WHEN action = 'move' THEN struct_pack(x := x, y := y) END IGNORE NULLS) OVER w AS at_, last_value(CASE WHEN action IN ('enable', 'disable') THEN action END IGNORE NULLS) OVER w AS on_ FROM ok WINDOW w AS (PARTITION BY beacon_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
edited AS (SELECT b.beacon_id, floor_id, coalesce(at_.x, x) AS x, coalesce(at_.y, y) AS y, coalesce(on_ = 'enable', enabled) AS enabled, coalesce(lock_ = 'lock', false) AS locked, CASE WHEN at_ IS NULL THEN 'automatic' ELSE 'manual' END AS origin
           FROM beacon b LEFT JOIN state s ON s.beacon_id = b.beacon_id WHERE NOT coalesce(deleted, false)
           UNION ALL SELECT 1000000000 + r.seq, b.floor_id, coalesce(r.at_.x, b.x), coalesce(r.at_.y, b.y), coalesce(r.on_ = 'enable', b.enabled), false, 'manual' FROM running r JOIN beacon b ON b.beacon_id = r.beacon_id WHERE r.action = 'duplicate')"""
_NUM = lambda c: f"regexp_replace(CAST({c} AS varchar), '\\.0$', '')"


def _q(body: str, *more: str) -> str:
    return with_sql("+" + OUTCOME_SQL.lstrip() + body, "command", "beacon", *more)


_CSV = {
    "id": "'beacon-' || CASE WHEN b.beacon_id >= 1000 THEN b.beacon_id::varchar ELSE lpad(b.beacon_id::varchar, 3, '0') END", "floorId": "'floor-' || b.floor_id", "type": "'Navigation'", "enabled": "b.enabled::varchar", "locked": "'false'",
    "worldX": _NUM("round(b.x, 2)"), "worldY": _NUM("round(b.y, 2)"), "coverageRadius": _NUM("radius"), "reliableRadius": _NUM("radius"), "marginalRadius": _NUM("marginal"), "edgeId": "coalesce(edge_id::varchar, '')",
    "referenceDistance": f"coalesce({_NUM('round(dist, 2)')}, '')", "placementStrategy": "strategy", "notes": "CASE b.beacon_id % 5 WHEN 0 THEN '''=SUM(\"' || b.beacon_id || '\")' WHEN 1 THEN '''-check \"wall\", left' ELSE '' END",
}
_LINE = " || ',' || ".join("'\"' || replace(" + _CSV.get(f, "''") + ", '\"', '\"\"') || '\"'" for f in CSV_FIELDS)
_HEAD = ",".join(f'"{f}"' for f in CSV_FIELDS)

QUERIES = {
    "command_outcomes": Query(command_outcomes, _q(" SELECT * FROM outcome")),
    "deployment_after_commands": Query(deployment_after_commands, _q(" SELECT * FROM edited")),
    "invalid_after_commands": Query(invalid_after_commands, _q(", " + floor.SHAPES_SQL.lstrip() + ", pt AS (SELECT beacon_id AS pid, floor_id, x, y FROM edited)," + floor.conflict_sql("pt", "cf") + " SELECT pid AS beacon_id, conflict_off_path AS conflict, origin = 'automatic' AND NOT locked AS dropped FROM cf JOIN edited e ON e.beacon_id = pid WHERE conflict_off_path IS NOT NULL", "vertex", "capsule")),
    "affected_cells": Query(affected_cells, _q(", " + floor.SHAPES_SQL.lstrip() + """,
        """ + coverage.GRID_SQL + """, pt AS (SELECT floor_id * 1000000 + row_no * 1000 + col AS pid, floor_id, x, y FROM cell),""" + floor.conflict_sql("pt", "cf") + """,
        o AS (SELECT floor_id, beacon_id, x, y, enabled FROM beacon), n AS (SELECT floor_id, beacon_id, x, y, enabled FROM edited), ch AS ((FROM o EXCEPT ALL FROM n) UNION ALL (FROM n EXCEPT ALL FROM o)),
        disc AS (SELECT c.floor_id, c.x, c.y, coalesce(b.marginal, 9) AS r FROM ch c LEFT JOIN beacon b ON b.beacon_id = c.beacon_id WHERE c.enabled)
        SELECT p.floor_id, count(DISTINCT pid) AS cells FROM cf p JOIN disc d ON d.floor_id = p.floor_id AND sqrt(power(p.x-d.x, 2)+power(p.y-d.y, 2)) <= d.r + 1e-8 WHERE conflict IS NULL GROUP BY p.floor_id""", "vertex", "capsule", "floor")),
    "coverage_resolution": Query(coverage_resolution, with_sql("""+v AS (SELECT floor_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM vertex GROUP BY floor_id),
        r AS (SELECT *, least(1.0, 800 / greatest(w * 20, h * 20), sqrt(400000 / (w * 20 * h * 20))) AS ratio FROM v)
        SELECT floor_id, round(0.5 * greatest(1.0, sqrt(ceil(w / 0.5) * ceil(h / 0.5) / 40000)), 6) AS cell, CAST(greatest(3, floor(w * 20 * ratio)) AS bigint) AS raster_width, CAST(greatest(3, floor(h * 20 * ratio)) AS bigint) AS raster_height FROM r""", "vertex")),
    "beacon_csv": Query(beacon_csv, with_sql(f"+{placement.NEAR_EDGE_SQL} SELECT b.beacon_id, {_LINE} || chr(13) || chr(10) AS line FROM beacon b LEFT JOIN best e ON e.beacon_id = b.beacon_id UNION ALL SELECT -1, '{_HEAD}' || chr(13) || chr(10)", "edge", "beacon")),
    "deployment_document": Query(deployment_document, with_sql("""SELECT floor_id, '{"schemaVersion":1,"floorId":' || floor_id || ',"units":"metres","isRFSimulation":false,"beaconCount":' || count(*) || ',"beacons":[' ||
        string_agg('{"id":' || beacon_id || ',"enabled":' || enabled || ',"placementStrategy":"' || strategy || '"}', ',' ORDER BY beacon_id) || ']}' AS document FROM beacon GROUP BY floor_id""", "beacon")),
    "document_beacons": Query(document_beacons, with_sql("SELECT floor_id, beacon_id, enabled, strategy FROM beacon", "beacon")),
    "quality_report": Query(quality_report, f"""WITH cov AS ({coverage.QUERIES['floor_coverage_summary'].sql}), f AS ({with_sql('SELECT floor_id FROM floor', 'floor')}), b AS ({with_sql('SELECT floor_id, count(*) AS n FROM beacon GROUP BY floor_id', 'beacon')}), k AS ({with_sql('SELECT floor_id, count(*) AS n FROM node GROUP BY floor_id', 'node')})
        SELECT f.floor_id, CASE WHEN cells IS NULL THEN 'analysis-failed' WHEN coalesce(b.n, 0) > 0 THEN 'draft-generated' ELSE 'not-generated' END AS status, coverage_pct, coalesce(b.n, 0) AS beacons, coalesce(k.n, 0) AS nodes FROM f LEFT JOIN cov USING (floor_id) LEFT JOIN b USING (floor_id) LEFT JOIN k USING (floor_id)"""),
    "input_signature": Query(input_signature, _q(""", a AS (SELECT floor_id, sha256(string_agg(beacon_id || ':' || printf('%.2f', x) || ':' || printf('%.2f', y), ',' ORDER BY beacon_id)) AS s FROM beacon GROUP BY floor_id),
        z AS (SELECT floor_id, sha256(string_agg(beacon_id || ':' || printf('%.2f', x) || ':' || printf('%.2f', y), ',' ORDER BY beacon_id)) AS t FROM edited GROUP BY floor_id)
        SELECT floor_id, s AS signature, coalesce(s = t, false) AS unchanged FROM a LEFT JOIN z USING (floor_id)""")),
    "content_hash_lookup": Query(content_hash_lookup, "SELECT page_id, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS reference, page_id <> min(page_id) OVER (PARTITION BY coalesce(html, '')) AS known FROM pages"),
    "preserved_and_generated": Query(preserved_and_generated, _q(""", kept AS (SELECT beacon_id, floor_id, x, y FROM edited WHERE locked)
        SELECT beacon_id, 'kept' AS origin FROM kept UNION ALL SELECT beacon_id, 'generated' FROM beacon b WHERE enabled AND beacon_id NOT IN (SELECT beacon_id FROM kept) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.floor_id = b.floor_id AND sqrt(power(k.x-b.x, 2)+power(k.y-b.y, 2)) <= 0.25 + 1e-8)""")),
    "stream_state_changes": Query(stream_state_changes, """SELECT user_id, event_id, ts, was, event_type AS now, CASE WHEN was IS NULL THEN 'connect' ELSE 'handover' END AS kind
        FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type"""),
    "stream_last_event": Query(stream_last_event, "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
}
