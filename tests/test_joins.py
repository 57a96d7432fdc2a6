"""Joins with rows dealt to bins are not sent to the driver, however small the planner takes them for."""

from pyspark.sql import functions as F

from atrium.operators import spatial
from atrium.plans import coverage
from atrium.sources.derive import derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_dealt_to_bins_are_not_broadcast(spark, tmp_path):
    # A file, as the planner knows how small it is.
    spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 9.0, 9.0)], "id long, floor_id long, x double, y double").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    discs = points.select("floor_id", F.col("id").alias("other"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = spatial.disc_join(points, discs, F.lit(2.0), 2.0)
    assert "BroadcastHashJoin" not in plan(near) and "SortMergeJoin" in plan(near)
    assert sorted((r.id, r.other) for r in near.collect()) == [(1, 1), (2, 2)]


def test_nodes_are_not_broadcast_to_edges(spark):
    for df in (coverage.ends(spark, SF), derived(spark, SF, "edge")):
        assert "BroadcastHashJoin" not in plan(df)
