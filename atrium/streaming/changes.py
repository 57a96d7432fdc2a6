"""State changes of a stream of events, keyed by user, kept in the stream's state store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from atrium.sources.shared import forget, shared_dir, step

OUT = "user_id long, event_id long, ts timestamp, was string, now string, kind string"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One row for each event whose type differs from the user's last one. The state is the last type alone."""
    was = state.get[0] if state.exists else None
    # Rows of a key may come in several frames whose numbers repeat.
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
    before = rows["event_type"].shift(1)
    before.iloc[0] = was
    changed = rows[rows["event_type"].ne(before) | before.isna()]
    was_of = before[changed.index]
    state.update((rows["event_type"].iloc[-1],))
    yield pd.DataFrame({"user_id": changed["user_id"], "event_id": changed["event_id"], "ts": changed["ts"], "was": was_of.where(was_of.notna(), None), "now": changed["event_type"], "kind": ["connect" if pd.isna(x) else "handover" for x in was_of]})


def state_changes(events: DataFrame) -> DataFrame:
    """Streaming (user_id, event_id, ts, was, now, kind) of events (event_id, ts, user_id, event_type).

    A user's events of one micro-batch are put in order and must fit one task; only the last type is kept between batches.
    """
    return events.groupBy("user_id").applyInPandasWithState(_changes, OUT, "last string", "append", GroupStateTimeout.NoTimeout)


def once_each(commands: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming commands (seq, ts, ...) without those sent again; numbers are remembered until the watermark passes."""
    return commands.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["seq"])


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Streaming counts and sums of events per type and window of event time; late events count until the watermark passes."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into files of the shared folder, and reads them."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


#: Partitions of a table kept current; a batch rewrites those that its keys fall in.
BUCKETS = 64


def kept_current(stream: DataFrame, key: list[str], order: str, at: str, buckets: int = BUCKETS) -> DataFrame:
    """The last row of each key of a stream, as a table in the folder ``at`` (foreachBatch).

    A micro-batch reads and rewrites only the buckets its keys fall in. Called again on the same folder, it goes on
    after the last batch that was done; a batch that was cut short is done again, which changes nothing twice. ``order`` tells
    the last row of a key; of rows with the same order either may stay.
    """
    spark = stream.sparkSession
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, __bucket int"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("__bucket").parquet(f"{at}/rows")
    table = lambda: spark.read.schema(schema).option("basePath", f"{at}/rows").parquet(f"{at}/rows")

    def merge(batch: DataFrame, number: int) -> None:
        fresh = step(batch.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "batch")
        before = table().join(fresh.select("__bucket").distinct(), "__bucket", "left_semi")
        last = before.unionByName(fresh).groupBy(*key).agg(F.max_by(F.struct(*stream.columns, "__bucket"), order).alias("r")).select("r.*")
        last = step(last, "merged")
        last.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{at}/rows")
        forget(fresh, last)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table().drop("__bucket")


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, be it one file or a folder of them (a pattern stands for both)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")
