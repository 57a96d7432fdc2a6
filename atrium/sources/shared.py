"""Steps of iterative jobs, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a new one only where it is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not at and master.startswith("local") and "cluster" not in master:
        at = tempfile.mkdtemp(prefix="atrium-")
        spark.sparkContext.setCheckpointDir(at)
    if not at:
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return at


def step(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a result and reads it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as the session shuffles to, before they become many more.

    With the number given, adaptive execution does not put the tasks together, however few bytes the rows are until then.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def forget(*steps: DataFrame) -> None:
    """Deletes the files of steps that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        base = shared_dir(spark).rstrip("/").removeprefix("file:")
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if base.lstrip("/") in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
