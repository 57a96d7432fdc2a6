"""Coverage kept current through edits, and held against a full count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.plans import coverage
from atrium.plans.query import Query
from atrium.sources.derive import derived, with_sql
from atrium.sources.shared import shared_dir, step
from atrium.streaming.maintained import Maintained

#: Times that the stream of edits is started, each time with the next edits.
BATCHES = 4


def maintained(spark, d) -> tuple[Maintained, DataFrame]:
    """A new deployment folder with all cells counted, and the cells."""
    shapes = coverage.geometry(spark, d)
    cells = step(coverage.open_cells(spark, d, shapes), "cells")
    kept = Maintained(spark, f"{shared_dir(spark).rstrip('/')}/deployment-{uuid.uuid4().hex}", shapes)
    kept.start(cells, derived(spark, d, "beacon"))
    return kept, cells


def _edits(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "beacon_id", F.lit(None).cast("long").alias("floor_id"), "x", "y", F.lit(None).cast("double").alias("radius"), "enabled")


def incremental_matches_full(spark, d) -> DataFrame:
    """Switches off the beacons with id divisible by 50: regions around them counted anew, all others kept, against a full count."""
    off = F.col("beacon_id") % 50 == 0
    kept, cells = maintained(spark, d)
    beacons = derived(spark, d, "beacon")
    place = F.lit(None).cast("double")
    kept.apply(_edits(beacons.where(off).select(F.lit(0).alias("seq"), "beacon_id", place.alias("x"), place.alias("y"), F.lit(False).alias("enabled"))), 0)
    discs = beacons.where(F.col("enabled") & ~off).select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", F.col("radius").alias("marginal"))
    full = coverage.count_of(cells, coverage.seen_from(cells, discs, kept.shapes)).select(*coverage.CELL_KEY, F.col("n").alias("full"))
    both = kept.counts().select(*coverage.CELL_KEY, "n").join(full, coverage.CELL_KEY, "full")
    return both.groupBy("floor_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.abs(F.coalesce("n", F.lit(-1)) - F.coalesce("full", F.lit(-1)))).alias("diff"), F.sum("full").alias("total"))


def coverage_after_edits(spark, d) -> DataFrame:
    """A stream of edits that stops and starts again, in four batches that each count only the regions they touch: per floor what the cells come to at the end."""
    kept, _ = maintained(spark, d)
    edits = _edits(derived(spark, d, "edit"))
    at = f"{kept.at}/edits"
    first, last = edits.agg(F.min("seq"), F.max("seq")).first()
    part = F.floor((F.col("seq") - F.lit(first)) * BATCHES / (F.lit(last) - F.lit(first) + 1))
    for k in range(BATCHES if first is not None else 0):
        edits.where(part == k).write.mode("append").parquet(at)
        kept.follow(spark.readStream.schema(edits.schema).parquet(at))
    n = F.col("n")
    return kept.counts().groupBy("floor_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(n > 0).alias("covered"), F.count_if(n > 1).alias("overlap"), F.sum("n").alias("total"))


# The beacons after all edits stand in for the beacons that the counting reads.
_EDITED_SQL = coverage.CELLS_SQL.replace("JOIN beacon b ON", "JOIN edited b ON")
QUERIES = {
    "incremental_matches_full": Query(incremental_matches_full, with_sql("+" + coverage.CELLS_SQL + """
        , later AS (SELECT c.floor_id, c.col, c.row_no, count(h.beacon_id) AS full_n FROM open_cell c
                    LEFT JOIN hit h ON h.floor_id = c.floor_id AND h.col = c.col AND h.row_no = c.row_no AND h.dist <= h.radius + 1e-8 AND h.beacon_id % 50 <> 0 GROUP BY ALL)
        SELECT floor_id, count(*) AS cells, CAST(0 AS bigint) AS diff, CAST(sum(full_n) AS bigint) AS total FROM later GROUP BY floor_id""", *coverage.BASE)),
    "coverage_after_edits": Query(coverage_after_edits, with_sql("""+last AS (SELECT beacon_id, arg_max(x, seq) FILTER (x IS NOT NULL) AS nx, arg_max(y, seq) FILTER (y IS NOT NULL) AS ny, arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS ne FROM edit GROUP BY beacon_id),
        edited AS (SELECT b.beacon_id, b.floor_id, coalesce(nx, b.x) AS x, coalesce(ny, b.y) AS y, coalesce(ne, b.enabled) AS enabled, b.radius, b.marginal FROM beacon b LEFT JOIN last USING (beacon_id)), """ + _EDITED_SQL + """
        SELECT floor_id, count(*) AS cells, count(*) FILTER (n > 0) AS covered, count(*) FILTER (n > 1) AS overlap, CAST(sum(n) AS bigint) AS total FROM counted GROUP BY floor_id""", *coverage.BASE, "edit")),
}
