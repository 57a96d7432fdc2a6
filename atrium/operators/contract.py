"""Graphs made smaller: chains through nodes of degree 2 in their order, dead ends taken off, short links contracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrium.operators.rings import ranked_cycles
from atrium.sources.shared import forget, step

#: Places along a chain that one task adds up.
BLOCK = 4096


def _whole(edges: DataFrame) -> DataFrame:
    """Edges with an id and both ends, once each (of repeated ids the least row); a missing length counts as 0."""
    length = F.coalesce(F.when(~F.isnan("length"), F.col("length")), F.lit(0.0)).cast("double")
    rows = edges.where("edge_id is not null and source is not null and target is not null").groupBy("edge_id").agg(F.min(F.struct("source", "target", length.alias("length"))).alias("__row"))
    return rows.select("edge_id", "__row.*")


def _darts(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (edge_id, back, a, b, length)."""
    one = edges.select("edge_id", F.lit(False).alias("back"), F.col("source").alias("a"), F.col("target").alias("b"), "length")
    return one.unionByName(edges.select("edge_id", F.lit(True).alias("back"), F.col("target").alias("a"), F.col("source").alias("b"), "length"))


def _ends(edges: DataFrame, stops: DataFrame | None) -> DataFrame:
    """(node_id, degree, stop) of nodes with an edge; a loop counts twice. A stop is a node where chains end."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    out = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    if stops is None:
        return out.withColumn("stop", F.lit(False))
    return out.join(stops.select("node_id", F.lit(True).alias("stop")).distinct(), "node_id", "left").withColumn("stop", F.coalesce("stop", F.lit(False)))


def prefix_sums(rows: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one by ``order`` (0, 1, ...). Long groups are cut in blocks, whose sums are added up first."""
    at = rows.withColumn("__block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0.0))).drop("__sum")
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return at.join(sums, [*keys, "__block"]).withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0.0))).drop("__block", "__base")


def chains(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Edges (edge_id, source, target, length) in chains: (chain, seq, edge_id, a, b, length, offset, edges, closed).

    A chain goes on through nodes with exactly two edge ends and ends at all others and at ``stops`` (node_id). It runs
    from its lesser end (ties: the lesser first edge, then along that edge's own direction); a ring without an end starts with its
    least edge along that edge's direction. ``chain`` is the least edge id in it. An edge goes from ``a`` to ``b`` there, ``offset`` metres on.

    Both directions of a chain, with a turn at each end, make one cycle of directed edges, and a ring makes two, so
    one ranking of cycles by pointer doubling orders all of them in as many rounds as the logarithm of the longest.
    Rows without an id or an end are left out, repeated ids count once, a missing length counts as 0; other columns are not read.
    """
    edges = step(_whole(edges), "edges")
    darts = step(_darts(edges).withColumn("edge", F.struct("edge_id", "back")), "darts")
    through = _ends(edges, stops).where("degree = 2 and not stop").select("node_id")
    # At a node of two ends: the dart that leaves by the other one. Two rows a node at most.
    leaving = darts.join(through, darts["a"] == through["node_id"]).groupBy("node_id").agg(F.min("edge").alias("p"), F.max("edge").alias("q"))
    turned = F.struct("edge_id", (~F.col("back")).alias("back"))
    at = darts.join(leaving, darts["b"] == leaving["node_id"], "left")
    following = F.when(F.col("p").isNull(), turned).when(F.col("p") == turned, F.col("q")).otherwise(F.col("p"))
    cycles = ranked_cycles(at.select("edge", following.alias("next"))).withColumnRenamed("length", "darts")
    ends = darts.join(through, darts["a"] == through["node_id"], "left_anti").select("edge", F.lit(True).alias("starts"))
    ranked = step(cycles.join(darts, "edge").join(ends, "edge", "left"), "ranked")
    forget(edges, darts)
    start = ranked.groupBy("ring").agg(
        F.min(F.when(F.col("starts"), F.struct("a", "edge_id", "back", "seq"))).alias("s"),
        F.min("edge_id").alias("chain"),
    )
    # Of a ring's two cycles the one along its least edge stays; of an open chain's cycle the half from its start.
    start = start.where("s is not null or not ring.back").select("ring", "chain", F.coalesce("s.seq", F.lit(0)).alias("first"), F.col("s").isNull().alias("closed"))
    on = ranked.join(start, "ring").withColumn("edges", F.when(F.col("closed"), F.col("darts")).otherwise(F.floor(F.col("darts") / 2)).cast("long"))
    on = on.withColumn("seq", F.pmod(F.col("seq") - F.col("first"), F.col("darts"))).where("seq < edges")
    out = prefix_sums(on.select("chain", "seq", "edge_id", "a", "b", "length", "edges", "closed"), ["chain"], "seq", "length", "offset")
    return out.select("chain", "seq", "edge_id", "a", "b", "length", "offset", "edges", "closed")


def merged(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Chains as single edges: (edge_id, source, target, length, edges), ``edge_id`` the chain. A ring is a loop at its first node."""
    order = chains(edges, stops)
    ends = order.groupBy(F.col("chain").alias("edge_id")).agg(F.min_by("a", "seq").alias("source"), F.max_by("b", "seq").alias("target"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("edges"))
    return ends


def pruned(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Edges (edge_id, source, target, length) that are left when dead ends are taken off until none is there: nodes with one edge go, but for ``keep`` (node_id).

    Chains are merged first, so a dead end of any length goes in one round; every round takes all of them off at
    once. A tree's rounds are at most the logarithm of its leaves. What is left does not depend on the order.
    """
    edges = step(_whole(edges), "edges")
    # Which chain of the graph as it is now an edge of the given graph is in.
    holds = edges.select("edge_id", F.col("edge_id").alias("now"))
    left = edges
    while True:
        order = step(chains(left, keep), "order")
        now = order.groupBy("chain").agg(F.min_by("a", "seq").alias("source"), F.max_by("b", "seq").alias("target"), F.sum("length").alias("length"))
        now = now.withColumnRenamed("chain", "edge_id")
        dead = _ends(now, keep).where("degree = 1 and not stop").select("node_id")
        gone = now.join(dead.select(F.col("node_id").alias("source")), "source", "left_semi").select("edge_id").unionByName(now.join(dead.select(F.col("node_id").alias("target")), "target", "left_semi").select("edge_id"))
        then = step(now.join(gone.distinct(), "edge_id", "left_anti"), "pruned")
        kept = order.join(then.select(F.col("edge_id").alias("chain")), "chain", "left_semi").select(F.col("edge_id").alias("now"), "chain")
        holds = step(holds.join(kept, "now").select("edge_id", F.col("chain").alias("now")), "holds")
        settled = gone.isEmpty()
        forget(order, *([left] if left is not edges else []))
        left = then
        if settled:
            return edges.join(holds, "edge_id", "left_semi")


def contracted(edges: DataFrame, shortest: float, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges shorter than ``shortest`` contracted one by one in order of their id: what is left, and (node_id, into, edge_id) of each contraction.

    A short edge between different nodes, none of them in ``keep``, goes; its target becomes its source, and every other
    edge grows by its length at each end that it had there. Edges only get longer, so a short edge's turn comes when no
    earlier short edge is at either of its nodes: all such edges go in one round, with the result of the walk in order.
    Rounds are as many as the longest run of neighbouring short edges in falling order.
    """
    now = step(_whole(edges), "edges")
    done = []
    while True:
        short = now.where((F.col("length") < shortest) & (F.col("source") != F.col("target")))
        if keep is not None:
            held = keep.select("node_id").distinct()
            short = short.join(held, short["source"] == held["node_id"], "left_anti").join(held, F.col("target") == held["node_id"], "left_anti")
        short = step(short, "short")
        first = short.select(F.explode(F.array("source", "target")).alias("node_id"), "edge_id").groupBy("node_id").agg(F.min("edge_id").alias("first"))
        at = lambda k: first.select(F.col("node_id").alias(k), F.col("first").alias(f"{k}_first"))  # noqa: B023, E731
        taken = short.join(at("source"), "source").join(at("target"), "target").where("edge_id = source_first and edge_id = target_first")
        taken = step(taken.select(F.col("target").alias("node_id"), F.col("source").alias("into"), "edge_id", F.col("length").alias("more")), "taken")
        if taken.isEmpty():
            forget(short, taken)
            break
        done.append(taken)
        end = lambda k: taken.select(F.col("node_id").alias(k), F.col("into").alias(f"{k}_into"), F.col("more").alias(f"{k}_more"))  # noqa: B023, E731
        others = now.join(taken.select("edge_id"), "edge_id", "left_anti").join(end("source"), "source", "left").join(end("target"), "target", "left")
        grown = F.col("length") + F.coalesce("source_more", F.lit(0.0)) + F.coalesce("target_more", F.lit(0.0))
        then = step(others.select("edge_id", F.coalesce("source_into", "source").alias("source"), F.coalesce("target_into", "target").alias("target"), grown.alias("length")), "edges")
        forget(now, short)
        now = then
    none = now.limit(0).select(F.col("source").alias("node_id"), F.col("source").alias("into"), "edge_id")
    return now, reduce(DataFrame.unionByName, [t.select("node_id", "into", "edge_id") for t in done], none)
