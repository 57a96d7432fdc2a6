"""Graph operators over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.sources.shared import forget, step


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each undirected edge from either end: (a, b, carried)."""
    one = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), *carry)
    return one.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), *carry))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node_id, label): the least node of the component.

    A node takes the least label among its neighbours, then the label's own
    label, so labels travel in doubling steps. Rounds end when none changes.
    """
    links = step(both_ways(edges).distinct(), "links")
    now = step(nodes.select("node_id", F.col("node_id").alias("label")), "labels")
    for _ in range(most_rounds):
        seen = links.join(now, links["b"] == now["node_id"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = now.join(seen, now["node_id"] == seen["a"], "left").select("node_id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = hooked.select(F.col("node_id").alias("l"), F.col("label").alias("next"))
        then = hooked.join(jump, hooked["label"] == jump["l"], "left").select("node_id", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        then = step(then, "labels")
        forget(now)
        now = then.select("node_id", "label")
        if then.where("label <> old").isEmpty():
            forget(links)
            return now
    raise RuntimeError("components did not settle")


#: Doublings of the arcs that a round of ``costs`` takes: up to 2^3 edges.
DOUBLINGS = 3


def _cheapest(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(F.struct("cost", "path", "distance")).alias("r")).select(*key, "r.cost", "r.distance", "r.path")


def _spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """The least cost, and the least and the greatest length of what has it."""
    out = rows.groupBy(*key).agg(F.min(F.struct("cost", "least")).alias("r"), F.min(F.struct("cost", (-F.col("most")).alias("m"))).alias("s"))
    return out.select(*key, "r.cost", "r.least", (-F.col("s.m")).alias("most"))


#: Written rounds that are read again before they are merged into one.
MERGED = 8


def _settled(rounds: list[DataFrame], key: list[str], best) -> list[DataFrame]:
    """The rounds so far, merged into one table when there are many; the last stays apart as the front."""
    if len(rounds) <= MERGED:
        return rounds
    merged = step(best(reduce(DataFrame.unionByName, rounds)), "merged")
    forget(*rounds[:-1])
    return [merged, rounds[-1]]


#: Nodes of a round, with their arcs and routes, that joins may send to all tasks.
SENT = 20_000


def _side(df: DataFrame, nodes: int) -> DataFrame:
    """One side of a join, to be sorted and merged where it tells of many nodes.

    Files of paths and ids are many times smaller than their rows: by the files' size the planner would send millions of
    rows through the driver.
    """
    return df.hint("merge") if nodes > SENT else df


def _going(arcs: DataFrame) -> DataFrame:
    """Nodes that are taken out in a round: those with fewer neighbours than all of their neighbours, ties by a hash, so no two of them are neighbours."""
    ends = arcs.select(F.col("b").alias("node_id"), F.col("a").alias("other")).unionByName(arcs.where("a is not null").select(F.col("a").alias("node_id"), F.col("b").alias("other")))
    near = ends.groupBy("node_id").agg(F.collect_set("other").alias("others"))
    near = near.select("node_id", "others", F.struct(F.size("others").alias("n"), F.xxhash64("node_id").alias("h"), F.col("node_id").alias("i")).alias("rank"))
    none = F.lit(None).cast(near.schema["rank"].dataType)
    told = near.select("node_id", F.col("rank").alias("own"), none.alias("least")).unionByName(near.select(F.explode("others").alias("node_id"), none.alias("own"), F.col("rank").alias("least")))
    return told.groupBy("node_id").agg(F.max("own").alias("own"), F.min("least").alias("least")).where("least is null or own < least").select("node_id")


def _searched(first: DataFrame, arcs: DataFrame, best, followed: dict[str, Column], within: float | None, only: DataFrame | None = None) -> DataFrame:
    """(source, node_id, values): the best route from each source to each node, in rounds that follow the logarithm of the graph's size.

    Up: a round takes out nodes that are not neighbours, those with few neighbours first, and puts an arc over each for every
    pair of arcs through it, so what is left is smaller and its routes are as good. Down: a node's best route comes by an arc
    from a node taken out after it, or straight from a source. Work grows with the nodes where rounds leave few arcs a node, as on
    plans of floors; on a graph that is linked everywhere with everything they grow with the square.
    ``first``: source, node_id, values; ``arcs``: a, b, values; ``followed``: the values of an arc and another (with a 2) after it;
    ``only`` (node_id) may name the nodes that are asked for.
    """
    values, key = list(followed), ["source", "a", "b"]
    near = (lambda df: df) if within is None else (lambda df: df.where(F.col("cost") <= within))
    sources = first.select("source", F.lit(None).cast(arcs.schema["a"].dataType).alias("a"), F.col("node_id").alias("b"), *values)
    left = step(best(near(sources.unionByName(arcs.select(F.lit(None).cast(first.schema["source"].dataType).alias("source"), "a", "b", *values))), key), "arcs")
    rounds = []
    while True:
        going = step(_going(left), "going")
        n = going.count()
        if not n:
            forget(going, left)
            break
        rounds.append((left, going, n))
        at = lambda k: _side(going.select(F.col("node_id").alias(k)), n)  # noqa: B023, E731
        onward = left.where("a is not null").join(at("a"), "a", "left_semi").select(F.col("a").alias("m"), F.col("b").alias("c"), *[F.col(v).alias(f"{v}2") for v in values])
        over = left.join(at("b"), "b", "left_semi").join(_side(onward, n), F.col("b") == F.col("m")).where("a is null or a <> c").select("source", "a", F.col("c").alias("b"), *[c.alias(v) for v, c in followed.items()])
        # Arcs from a source have no a; they are dealt by b, not all to one task.
        rest = left.join(at("b"), "b", "left_anti").withColumn("k", F.coalesce("a", "b")).join(at("k"), "k", "left_anti").select(*key, *values)
        left = step(best(rest.unionByName(near(over)), key), "arcs")
    asked = []
    for arcs_then, going, n in rounds:
        if only is None:
            asked.append(going)
            continue
        mine = step(going.join(only.hint("merge"), "node_id", "left_semi"), "asked")
        asked.append(mine)
        via = arcs_then.where("a is not null").join(_side(mine.select(F.col("node_id").alias("b")), n), "b", "left_semi").select(F.col("a").alias("node_id"))
        only = step(only.join(_side(mine, n), "node_id", "left_anti").unionByName(via).distinct(), "only")
    parts: list[DataFrame] = []
    settled = 0
    for (arcs_then, _, n), mine in zip(reversed(rounds), reversed(asked), strict=True):
        settled += n
        into = arcs_then.join(_side(mine.select(F.col("node_id").alias("b")), n), "b", "left_semi")
        found = into.where("a is null").select("source", F.col("b").alias("node_id"), *values)
        if parts:
            known = reduce(DataFrame.unionByName, parts)
            arc = into.where("a is not null").select("a", "b", *[F.col(v).alias(f"{v}2") for v in values])
            found = found.unionByName(near(known.join(_side(arc, settled), F.col("node_id") == F.col("a")).select("source", F.col("b").alias("node_id"), *[c.alias(v) for v, c in followed.items()])))
        parts.append(step(best(found, ["source", "node_id"]), "found"))
        if len(parts) > MERGED:
            whole = step(reduce(DataFrame.unionByName, parts), "found")
            forget(*parts)
            parts = [whole]
    forget(*[x for arcs_then, going, _ in rounds for x in (arcs_then, going)])
    return reduce(DataFrame.unionByName, parts) if parts else first.select("source", "node_id", *values)


def _plus(name: str) -> Column:
    return F.round(F.col(name) + F.col(f"{name}2"), 6)


def routes(sources: DataFrame, arcs: DataFrame, within: float | None = None, only: DataFrame | None = None) -> DataFrame:
    """(source, node_id, cost, distance, path): the cheapest route from each source to every node it reaches, ties to the least path.

    ``sources``: source, node_id, and cost if a search starts with one; ``arcs``: a, b, cost, distance, edge_id, directed.
    Costs are rounded to 6 decimals. ``within`` bounds the cost. ``only`` (node_id) may name the nodes that are asked for;
    others may come too. Where paths are not asked for, ``costs`` and ``lengths`` are lighter.
    """
    cost = F.col("cost") if "cost" in sources.columns else F.lit(0.0)
    first = sources.select("source", "node_id", cost.alias("cost"), F.lit(0.0).alias("distance"), F.array().cast("array<bigint>").alias("path"))
    arcs = arcs.select("a", "b", F.round("cost", 6).alias("cost"), F.col("distance").cast("double").alias("distance"), F.array(F.col("edge_id").cast("bigint")).alias("path"))
    followed = {"cost": _plus("cost"), "distance": _plus("distance"), "path": F.concat("path", "path2")}
    return _searched(first, arcs, _cheapest, followed, within, only).select("source", "node_id", "cost", "distance", "path")


def lengths(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, node_id, cost, distance): what ``routes`` tells, without the paths.

    The cheapest routes to a node are mostly of one length, whichever of them is the least path. Only for nodes with
    cheapest routes of several lengths are paths looked at.
    """
    cost = F.col("cost") if "cost" in sources.columns else F.lit(0.0)
    first = sources.select("source", "node_id", cost.alias("cost"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))
    length = F.col("distance").cast("double")
    spans = _searched(first, arcs.select("a", "b", F.round("cost", 6).alias("cost"), length.alias("least"), length.alias("most")), _spans, {v: _plus(v) for v in ("cost", "least", "most")}, None)
    out, tied = spans.where("least = most").select("source", "node_id", "cost", F.col("least").alias("distance")), spans.where("least < most")
    if tied.isEmpty():
        return out
    told = routes(sources, arcs, only=tied.select("node_id").distinct()).join(tied.select("source", "node_id").hint("merge"), ["source", "node_id"], "left_semi")
    return out.unionByName(told.select("source", "node_id", "cost", "distance"))


def costs(sources: DataFrame, arcs: DataFrame, within: float | None = None) -> DataFrame:
    """(source, node_id, cost): what ``routes`` costs, without the routes. Rows are three numbers."""
    cheapest = lambda rows, key: rows.groupBy(*key).agg(F.min("cost").alias("cost"))
    arcs = step(cheapest(arcs.select("a", "b", F.round("cost", 6).alias("cost")), ["a", "b"]), "arcs")
    for _ in range(DOUBLINGS):
        longer = arcs.join(arcs.select(F.col("a").alias("m"), F.col("b").alias("c"), F.col("cost").alias("more")), F.col("b") == F.col("m")).where("a <> c")
        wider = step(cheapest(arcs.unionByName(longer.select("a", F.col("c").alias("b"), F.round(F.col("cost") + F.col("more"), 6).alias("cost"))), ["a", "b"]), "arcs")
        forget(arcs)
        arcs = wider
    start = F.col("cost") if "cost" in sources.columns else F.lit(0.0)
    key = ["source", "node_id"]
    over = arcs.select("a", "b", F.col("cost").alias("more"))
    rounds = [step(cheapest(sources.select(*key, start.alias("cost")), key), "front")]
    while True:
        front = rounds[-1]
        on = front.join(over, front["node_id"] == over["a"]).select("source", F.col("b").alias("node_id"), F.round(F.col("cost") + F.col("more"), 6).alias("new"), F.lit(None).cast("double").alias("old"))
        on = on if within is None else on.where(F.col("new") <= within)
        known = reduce(DataFrame.unionByName, rounds).select(*key, F.lit(None).cast("double").alias("new"), F.col("cost").alias("old"))
        both = on.unionByName(known).groupBy(*key).agg(F.min("new").alias("new"), F.min("old").alias("old"))
        front = step(both.where("new is not null and (old is null or new < old)").select(*key, F.col("new").alias("cost")), "front")
        if front.isEmpty():
            forget(front)
            return cheapest(reduce(DataFrame.unionByName, rounds), key)
        rounds = _settled([*rounds, front], key, lambda rows: cheapest(rows, key))


def mergeable_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of degree 2 and the two edges that meet there: (node_id, first, second, length)."""
    ends = edges.select(F.col("source").alias("node_id"), "edge_id", "distance").unionByName(edges.select(F.col("target").alias("node_id"), "edge_id", "distance"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first"), F.max("edge_id").alias("second"), F.sum("distance").alias("length")).where("n = 2").drop("n")


def spanning_forest(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, rank) those that, taken in order of rank, each join two parts of the graph that are apart until then: (a, b, rank).

    ``rank`` is any sortable value, different for each pair. Each round takes, for every part, its first pair to
    another part; these are all among the pairs that the walk in order takes, and the parts they join become one. At least
    half of the parts with a pair go in a round, so rounds are as many as the logarithm of the number of parts.
    """
    labels = components(nodes, edges)
    end = lambda k: labels.select(F.col("node_id").alias(k), F.col("label").alias(f"l{k}"))
    left = step(pairs.join(end("a"), "a").join(end("b"), "b").where("la <> lb"), "pairs")
    taken = []
    while not left.isEmpty():
        sides = left.select(F.explode(F.array("la", "lb")).alias("part"), F.struct("rank", "a", "b", "la", "lb").alias("p"))
        first = step(sides.groupBy("part").agg(F.min("p").alias("p")).select("p.*").distinct(), "taken")
        taken.append(first)
        joined = first.select(F.col("la").alias("source"), F.col("lb").alias("target"))
        parts = left.select(F.explode(F.array("la", "lb")).alias("node_id")).distinct()
        now = components(parts, joined)
        to = lambda k: now.select(F.col("node_id").alias(k), F.col("label").alias(f"n{k}"))  # noqa: B023, E731
        then = left.join(to("la"), "la").join(to("lb"), "lb").where("nla <> nlb").select("a", "b", "rank", F.col("nla").alias("la"), F.col("nlb").alias("lb"))
        # Pairs between the same two parts: only the first can be taken.
        best = then.groupBy(F.least("la", "lb").alias("p"), F.greatest("la", "lb").alias("q")).agg(F.min(F.struct("rank", "a", "b", "la", "lb")).alias("r"))
        before, left = left, step(best.select("r.*"), "pairs")
        forget(before)
    return reduce(DataFrame.unionByName, taken).select("a", "b", "rank") if taken else left.select("a", "b", "rank")


def grid_components(cells: DataFrame, joined=None) -> DataFrame:
    """Groups of neighbouring cells (floor_id, col, row_no, x, y): adds zone_col and zone_row, the group's first cell by row, then column.

    ``joined`` may drop pairs of neighbours (floor_id, col, row_no, to_col, to_row, ax, ay, bx, by).
    """
    there = cells.select("floor_id", F.col("col").alias("to_col"), F.col("row_no").alias("to_row"), F.col("x").alias("bx"), F.col("y").alias("by"))
    step_to = F.explode(F.array(F.struct((F.col("col") + 1).alias("to_col"), F.col("row_no").alias("to_row")), F.struct(F.col("col").alias("to_col"), (F.col("row_no") + 1).alias("to_row"))))
    pairs = cells.select("floor_id", "col", "row_no", F.col("x").alias("ax"), F.col("y").alias("ay"), step_to.alias("n")).select("*", "n.*").drop("n").join(there, ["floor_id", "to_col", "to_row"])
    pairs = joined(pairs) if joined else pairs
    cell = lambda row, col: F.struct(F.col("floor_id").alias("f"), F.col(row).alias("r"), F.col(col).alias("c"))
    labels = components(cells.select(cell("row_no", "col").alias("node_id")), pairs.select(cell("row_no", "col").alias("source"), cell("to_row", "to_col").alias("target")))
    return labels.select(F.col("node_id.f").alias("floor_id"), F.col("node_id.c").alias("col"), F.col("node_id.r").alias("row_no"), F.col("label.c").alias("zone_col"), F.col("label.r").alias("zone_row"))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
