"""Steps whose result depends on order, as rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.sources.shared import forget, step


def first_kept(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Of rows (id) those that stay when, in order of id, each is dropped that is near one that stayed before: (id, kept).

    ``near``: pairs (id, earlier) with earlier < id. A row is decided once all its
    earlier neighbours are: dropped if one of them stays, kept if all are dropped.
    As many rounds as the longest chain of dependence; the result is that of the
    walk in order.
    """
    todo, links, done = step(rows.select("id"), "todo"), step(near.select("id", "earlier"), "near"), []
    while not todo.isEmpty():
        waits = links.join(todo.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct()
        kept = step(todo.join(waits, "id", "left_anti"), "kept")
        drop = step(links.join(kept.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct().join(todo, "id", "left_semi"), "drop")
        done += [kept.withColumn("kept", F.lit(True)), drop.withColumn("kept", F.lit(False))]
        gone = kept.unionByName(drop)
        rest = step(todo.join(gone, "id", "left_anti"), "todo")
        open_links = step(links.join(gone, "id", "left_anti").join(drop.select(F.col("id").alias("earlier")), "earlier", "left_anti"), "near")
        forget(todo, links)
        todo, links = rest, open_links
    return reduce(DataFrame.unionByName, done) if done else rows.select("id", F.lit(True).alias("kept")).limit(0)
