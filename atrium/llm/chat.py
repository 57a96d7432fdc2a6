"""Operator 9: chat formatting with cumulative-snapshot collapse (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per turn its place k (from 1), and two rolling hashes of the turns up to it."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.row_number().over(own))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    one = lambda seed: F.xxhash64(F.lit(seed), "k", "role", "text")
    return placed.withColumn("h1", F.bit_xor(one(1)).over(so_far)).withColumn("h2", F.bit_xor(one(2)).over(so_far))


def format_chats(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Collapses cumulative snapshots and renders what stays: (conv_id, n_turns, n_same, rendered).

    A log often holds the same conversation several times, each time with the
    turns so far. Each turn carries the rolling hash of its conversation up to
    it (128 bits: the xor of hashes of place, role and text, so one running
    aggregate gives it). A conversation goes if its last hash at its length is
    a hash inside a longer one. Of conversations that are equal throughout, the
    least conv_id stays and ``n_same`` tells how many there were. The others are
    rendered in turn order.

    Turns are ordered by (turn, role, text), so repeated turn numbers have a
    fixed order. Null roles and texts count as empty. A null conv_id is one
    conversation of its own. An empty table gives an empty result.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    hashed = prefix_hashes(turns)
    ends = Window.partitionBy("conv_id")
    keys = materialize(hashed.select("conv_id", "k", "h1", "h2", F.max("k").over(ends).alias("n")), "prefixes")
    whole = keys.where("k = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    inner = keys.where("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    stay = materialize(whole.join(inner, ["n", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("stay_id"), F.col("n").cast("long").alias("n_turns"), "n_same"), "maximal")
    kept = hashed.join(stay, F.col("conv_id").eqNullSafe(F.col("stay_id")))
    line = F.struct("k", F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end), F.lit("\n")).alias("line"))
    grouped = kept.groupBy("conv_id", "n_turns", "n_same").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("conv_id", "n_turns", "n_same", F.concat_ws("", F.col("lines.line")).alias("rendered"))


def chat_sql() -> str:
    """What format_chats returns, as SQL that compares whole prefixes instead of hashes."""
    return """
    WITH placed AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
      FROM conversations),
    lines AS (
      SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
             sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k)) AS h,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k) AS rendered
      FROM placed),
    ends AS (
      SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_same, min(rendered) AS rendered FROM lines WHERE k = n GROUP BY n, h)
    SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_same, rendered FROM ends e
    WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.k = e.n AND l.h = e.h AND l.n > e.n)
    """
