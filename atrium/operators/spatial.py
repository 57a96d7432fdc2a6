"""Distance joins on grid bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as G
from atrium.sources.shared import step


def _bin(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def spread(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row for each bin that a box touches (columns bx, by).

    The planner takes the rows for as many as came in and would send them all to the driver as a broadcast, so joins
    with them are told to sort and merge.
    """
    df = df.withColumn("bx", F.explode(F.sequence(_bin(x0, size), _bin(x1, size))))
    return df.withColumn("by", F.explode(F.sequence(_bin(y0, size), _bin(y1, size)))).hint("merge")


def disc_join(points: DataFrame, discs: DataFrame, radius: Column, size: float, how: str = "inner") -> DataFrame:
    """Pairs of points (floor_id, x, y, ...) and discs (floor_id, cx, cy, ...) with distance <= radius; adds ``dist``.

    Discs go to the bins they touch, points to one bin; the exact test follows
    the equi-join on (floor, bin), so no pair of far bins is ever built.
    """
    binned = spread(discs, F.col("cx") - radius, F.col("cy") - radius, F.col("cx") + radius, F.col("cy") + radius, size)
    binned = binned.withColumn("__r", radius)
    placed = points.withColumn("bx", _bin(F.col("x"), size)).withColumn("by", _bin(F.col("y"), size))
    near = G.distance(placed["x"], placed["y"], binned["cx"], binned["cy"])
    on = (placed["floor_id"] == binned["floor_id"]) & (placed["bx"] == binned["bx"]) & (placed["by"] == binned["by"]) & (near <= binned["__r"] + G.EPS)
    out = placed.join(binned, on, how).withColumn("dist", near)
    return out.drop(binned["floor_id"]).drop(binned["bx"]).drop(binned["by"]).drop("__r", "bx", "by")


def placed(*coordinates: Column) -> Column:
    """Are all coordinates there and finite?"""
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in coordinates])


def nearest(points: DataFrame, key: str, targets: DataFrame, target: str, measure, box, start: float = 8.0) -> DataFrame:
    """The nearest target on the same floor for each point: (key, target, dist), ties to the least target.

    ``box`` gives a target's bounding box, ``measure`` the distance. Search starts
    with bins of ``start`` metres; points that found nothing within that distance
    try again with four times as much, until each point on a floor with targets
    has one, which is at the latest when the reach is the floor's extent. Targets
    without a place (a null or non-finite coordinate) are left out; a point
    without one gets a null target.
    """
    targets = targets.where(placed(*box))
    here = points.join(targets.select("floor_id").distinct(), "floor_id", "left_semi")
    fine = placed(F.col("x"), F.col("y"))
    nowhere = here.where(~fine)
    todo, tried, reach, asked = here.where(fine), [], start, points.columns
    while True:
        x0, y0, x1, y1 = box
        bins = spread(targets, x0 - reach, y0 - reach, x1 + reach, y1 + reach, reach).withColumnsRenamed({"floor_id": "__f", "bx": "__bx", "by": "__by"})
        at = todo.withColumn("bx", _bin(F.col("x"), reach)).withColumn("by", _bin(F.col("y"), reach))
        pairs = at.join(bins, (F.col("floor_id") == F.col("__f")) & (F.col("bx") == F.col("__bx")) & (F.col("by") == F.col("__by"))).withColumn("dist", measure)
        best = pairs.where(F.col("dist") <= reach).groupBy(key).agg(F.min(F.struct(F.round("dist", 9).alias("d"), F.col(target).alias("t"))).alias("b"))
        tried.append(step(todo.join(best, key, "left"), "nearest"))
        todo = tried[-1].where("b is null").select(*asked)
        if todo.isEmpty():
            break
        reach *= 4
    found = [x.where("b is not null").select(key, F.col("b.t").alias(target), F.col("b.d").alias("dist")) for x in tried]
    none = found[0].schema
    return reduce(DataFrame.unionByName, [*found, nowhere.select(key, F.lit(None).cast(none[target].dataType).alias(target), F.lit(None).cast("double").alias("dist"))])


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``island``: the number of the run of equal values that a row belongs to."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn("island", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def interval_union(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Merges overlapping intervals of each key: (keys, lo, hi). Equal intervals count once, so the order has no ties."""
    df = df.select(*keys, lo, hi).distinct()
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col(lo) > before + 1e-9), 1).otherwise(0)
    runs = df.withColumn("__new", starts).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("__run")
