"""Coverage counts kept current by a stream of beacon edits: only regions that an edit touches are counted anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.operators import floor, spatial
from atrium.plans import coverage
from atrium.sources.shared import forget, step

BEACON = "floor_id long, beacon_id long, x double, y double, radius double, enabled boolean"
BEACON_COLUMNS = [c.split()[0] for c in BEACON.split(", ")]
COUNT = "col long, row_no long, x double, y double, n long, floor_id long, region string"
#: Folders of a batch, however many regions there are: the driver lists them all.
BUCKETS = 64
VERSION = "changed long, regions long, cells long, batch long"
FIELDS = ["floor_id", "x", "y", "radius", "enabled"]
PLACE = ["floor_id", "region"]


@dataclass(frozen=True)
class Maintained:
    """Counts of a deployment in a folder that all executors share.

    ``counts``: one row per open cell, whole regions (squares of ``region`` metres of a floor), at the start all of them and, for
    each batch, those that it counted anew; the newest of a region counts, what it replaced stays in its files. ``beacons``: the
    beacons at the start and, for each batch, those that it changed; ``versions``: one row per batch that is done, written last.
    A batch that was cut short is done again from the version before it and writes the same files, so a stream that is started
    again on the folder goes on where it stopped. Readers see a batch's counts once its version is written.
    """

    spark: SparkSession
    at: str
    shapes: floor.Geometry
    region: float = 32.0

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.at}/{name}").parquet(f"{self.at}/{name}")

    def _region(self) -> Column:
        return F.concat_ws("_", *[F.floor(F.col(c) / self.region).cast("long").cast("string") for c in ("x", "y")])

    def start(self, cells: DataFrame, beacons: DataFrame) -> None:
        """Counts all cells (floor_id, col, row_no, x, y) for the beacons (BEACON) they begin with."""
        self._log(beacons.select(*BEACON_COLUMNS), -1)
        cells = cells.select(*[F.col(c).cast("long").alias(c) for c in coverage.CELL_KEY], "x", "y").withColumn("region", self._region())
        self._write(self._counted(cells, beacons), -1)
        self._done(-1, self.spark.createDataFrame([], "beacon_id long"), self._rows().where("batch = -1"))

    def version(self) -> int | None:
        """The number of the last batch that is done; None before ``start``."""
        try:
            return self._read("versions", VERSION).agg(F.max("batch")).first()[0]
        except Exception as e:  # no such folder yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _rows(self) -> DataFrame:
        return self._read("counts", COUNT + ", batch long, bucket int")

    def counts(self) -> DataFrame:
        """The counts as of the last version."""
        rows = self._rows().where(F.col("batch") <= F.lit(self.version()))
        newest = rows.groupBy(*PLACE).agg(F.max("batch").alias("batch"))
        return rows.join(newest.hint("merge"), [*PLACE, "batch"], "left_semi").drop("batch", "bucket")

    def versions(self) -> DataFrame:
        """(batch, changed beacons, regions and cells counted anew)."""
        return self._read("versions", VERSION)

    def beacons(self) -> DataFrame:
        """The beacons as of the last version."""
        log = self._read("beacons", BEACON + ", batch long").where(F.col("batch") <= F.lit(self.version()))
        return log.groupBy("beacon_id").agg(F.max_by(F.struct(*FIELDS), "batch").alias("b")).select("b.floor_id", "beacon_id", *[f"b.{c}" for c in FIELDS[1:]])

    def apply(self, edits: DataFrame, number: int) -> None:
        """One batch of edits (seq, beacon_id, and floor_id, x, y, radius, enabled, where null keeps what is); the last of each field counts.

        Batches must come in the order of ``seq``: an edit counts as later than all those of batches before.
        A beacon that is not known yet is added if its floor and place are given; without a radius or a state it gets 5 m
        and is switched on. Batches that are done already are left out.
        """
        if number <= self.version():
            return
        known = self.beacons()
        last = edits.groupBy("beacon_id").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in FIELDS])
        both = last.join(known, "beacon_id", "left")
        fresh = {c: F.coalesce(f"new_{c}", c) for c in FIELDS}
        fresh |= {"radius": F.coalesce("new_radius", "radius", F.lit(5.0)), "enabled": F.coalesce("new_enabled", "enabled", F.lit(True))}
        after = F.struct(*[v.alias(c) for c, v in fresh.items()])
        before = F.when(F.col("floor_id").isNotNull(), F.struct(*FIELDS))
        changed = both.select("beacon_id", before.alias("before"), after.alias("after")).where(spatial.placed(F.col("after.x"), F.col("after.y")) & F.col("after.floor_id").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))
        changed = step(changed, "changed")
        self._log(changed.select("after.floor_id", "beacon_id", *[f"after.{c}" for c in FIELDS[1:]]), number)
        discs = changed.select(F.explode(F.array("before", "after")).alias("d")).select("d.*").where("enabled")
        reach = F.col("radius") + G.EPS
        touched = spatial.spread(discs, F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, self.region)
        touched = step(touched.select("floor_id", F.concat_ws("_", F.col("bx").cast("string"), F.col("by").cast("string")).alias("region")).distinct(), "touched")
        cells = self.counts().join(touched, PLACE, "left_semi").drop("n")
        now = known.join(changed.select("beacon_id"), "beacon_id", "left_anti").unionByName(changed.select("beacon_id", "after.*"))
        anew = step(self._counted(cells, now), "anew")
        self._write(anew, number)
        self._done(number, changed, anew)
        forget(changed, touched, anew)

    def follow(self, stream: DataFrame) -> None:
        """Applies all edits that a stream has; called again, it goes on after the last batch that was done."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def _counted(self, cells: DataFrame, beacons: DataFrame) -> DataFrame:
        discs = beacons.where("enabled").select("floor_id", "beacon_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", F.col("radius").alias("marginal"))
        near = coverage.seen_from(cells.drop("region"), discs, self.shapes)
        return coverage.count_of(cells, near).select("col", "row_no", "x", "y", F.col("n").cast("long").alias("n"), *PLACE)

    def _log(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.at}/beacons/batch={number}")

    def _write(self, counts: DataFrame, number: int) -> None:
        """Whole regions, newer than what they were; all other files stay untouched."""
        bucket = F.pmod(F.hash(*PLACE), F.lit(BUCKETS)).alias("bucket")
        rows = counts.select("*", bucket).repartition(BUCKETS, "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/counts/batch={number}")

    def _done(self, number: int, changed: DataFrame, anew: DataFrame) -> None:
        row = anew.agg(F.count_distinct(*PLACE).alias("regions"), F.count(F.lit(1)).alias("cells")).withColumn("changed", F.lit(changed.count()).cast("long"))
        row.select("changed", "regions", "cells").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/versions/batch={number}")

