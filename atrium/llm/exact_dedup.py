"""Operator 1: exact duplicates by progressive refinement (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import marks, materialize, row_key, salted_left_join, with_mark

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Marks exact copies: (id, carried columns, keep_id, group_size, kept).

    Groups are refined step by step. The first scan counts lengths alone. The
    second takes the prefix hashes of documents whose length occurs again. The
    third hashes whole texts of those whose (length, prefix hash) occurs again.
    Which rows go on is decided where they are read, by one bit for each of
    2^24 slots, so no step shuffles texts: what moves is ids, lengths and hashes.
    A row that goes on needlessly (its slot is shared) costs a hash and changes nothing.

    Of equal texts the row with the largest id stays. Rows that repeat the
    largest id of their group all count as kept and are separate members. A null
    id is smaller than any other; in a group that has no other, the null-id rows
    stay. Null text counts as empty; empty texts are copies of each other. An
    empty table gives an empty result. Columns not carried are ignored, whatever
    their names.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *[F.col(c) for c in carry])
    rows = rows.withColumn("__len", F.octet_length("__text")).withColumn("__prefix", F.xxhash64(F.substring("__text", 1, prefix_chars)))
    size, both = [F.col("__len")], [F.col("__len"), F.col("__prefix")]
    lengths = materialize(marks(_repeated(rows, "__len"), *size), "lengths")
    prefixes = _repeated(with_mark(rows, lengths, *size).where("__marked"), "__len", "__prefix")
    prefixes = materialize(marks(prefixes, *both), "prefixes")
    hashed = with_mark(rows, prefixes, *both).select("__id", *carry, "__len", F.when(F.col("__marked"), F.unhex(F.sha2("__text", 256))).alias("__full"))
    hashed = materialize(hashed, "hashed")
    groups = hashed.where("__full is not null").groupBy("__len", "__full").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keep")).where("__n > 1")
    out = salted_left_join(hashed, groups, ["__len", "__full"], F.col("__id"))
    keep = F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return out.select(F.col("__id").alias(id_col), *carry, keep.alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("__id")).alias("kept"))


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, in their own columns: one row of each text, with the text's largest id."""
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    kept = exact_dedup(keyed, id_col, text_col, ["__key"]).where("kept").select("__key").distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def ranked(df: DataFrame, key: str, order: list[str], fine: int, coarse: int = 1000, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row within its key, without one task per key.

    Rows are dealt by a hash of the ordering columns to ``fine`` buckets per key;
    ranks inside a bucket come from a window over the bucket, and the buckets'
    offsets from counts, summed at two levels.
    """
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(fine)).cast("int"))
    counts = dealt.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.floor(F.col("__b") / coarse).cast("int"))
    inner = Window.partitionBy(key, "__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy(key, "__c").agg(F.sum("__n").alias("__t")).withColumn("__above", F.coalesce(F.sum("__t").over(outer), F.lit(0)))
    offsets = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(tops.select(F.col(key).alias("__k2"), F.col("__c").alias("__c2"), "__above"), F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__c") == F.col("__c2")))
    offsets = offsets.select(F.col(key).alias("__k2"), F.col("__b").alias("__b2"), (F.col("__in") + F.col("__above")).alias("__offset"))
    own = Window.partitionBy(key, "__b").orderBy(*order)
    placed = dealt.withColumn("__r", F.row_number().over(own) - 1)
    out = placed.join(offsets, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__b") == F.col("__b2")))
    return out.withColumn(name, (F.col("__offset") + F.col("__r")).cast("long")).drop("__b", "__r", "__k2", "__b2", "__offset")
