"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a new one only where it is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        at = tempfile.mkdtemp(prefix="atrium-")
        spark.sparkContext.setCheckpointDir(at)
    if not at:
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return at


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a result to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialized step that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).rstrip("/").removeprefix("file://")
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if base in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is planned inside: whole texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(df[text_col], F.lit(""))


def slot(*cols: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def row_key(id_col: str, text_col: str = "text") -> Column:
    """128 bits of a row's id and text: a decision on a text comes back to its own rows, with null and repeated ids too."""
    return F.struct(*[F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias(f"k{seed}") for seed in (1, 2)])


#: Words of 64 slots that a set of marks has at most: 2^24 slots.
MARK_WORDS = 1 << 18


def marks(keys: DataFrame, *cols: Column, words: int = MARK_WORDS) -> DataFrame:
    """(__word, __bits): a bit for each slot that the keys take; at most ``words`` rows whatever the number of keys."""
    at = keys.select(slot(*cols, slots=words * 64).alias("__slot"))
    return at.groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, __slot & 63)")).alias("__bits"))


def with_mark(df: DataFrame, marked: DataFrame, *cols: Column, name: str = "__marked", words: int = MARK_WORDS) -> DataFrame:
    """Adds whether a row's key may be among the marked ones; always true for those. Decided on the map side, against a bounded broadcast."""
    out = df.withColumn("__slot", slot(*cols, slots=words * 64)).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(marked), "__word", "left")
    return out.withColumn(name, F.coalesce(F.expr("shiftright(__bits, __slot & 63) & 1L = 1L"), F.lit(False))).drop("__slot", "__word", "__bits")


def keep_slots(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of df whose key may occur in keys: an exact join must follow; no row of these keys is lost."""
    of = [F.col(c) for c in cols]
    return with_mark(df, marks(keys, *of), *of).where("__marked").drop("__marked")


def salted_left_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, salts: int = 8) -> DataFrame:
    """Left join to a side with unique keys, with every key's left rows dealt over ``salts`` partitions.

    The right side is repeated ``salts`` times. As both sides are exchanged for
    the join alone, adaptive execution can also split what is still too large.
    """
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], "left").drop("__salt")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, label), label the least node.

    Alternates large-star and small-star steps, each one aggregation by node;
    the number of steps grows with the logarithm of a component's size. Every
    step is written to the shared folder. No group is collected: each step needs
    only the least neighbour of a node.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sign = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    was = sign(now)
    if not was[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(most_rounds):
        least = both(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_left_join(both(now), least, ["a"], F.col("b"), 4).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_left_join(down, low, ["a"], F.col("b"), 4)
        then = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        then = materialize(then, "edges")
        forget(now)
        now, before, was = then, was, sign(then)
        if was == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
