"""Middle lines of masks: thinning in rounds over the cells that a round takes off, and the graph of what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.operators import contract
from atrium.sources.shared import forget, step

#: The neighbours of a cell, clockwise from above; a cell's neighbours that are there are one bit each.
AROUND = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
KEY = ["floor_id", "col", "row_no"]
#: The bit of the cell itself.
SELF = 256


def _goes(mask: int, turn: int) -> bool:
    """May a cell with these neighbours go? It has two to six of them in one run, and one of two triples of sides is open."""
    there = [mask >> j & 1 for j in range(8)]
    runs = sum(not there[j] and there[(j + 1) % 8] for j in range(8))
    above, right, below, left = there[0], there[2], there[4], there[6]
    triples = ((above, right, below), (right, below, left)) if turn == 0 else ((above, right, left), (above, below, left))
    return 2 <= sum(there) <= 6 and runs == 1 and not any(all(t) for t in triples)


def _table(turn: int) -> Column:
    return F.array(*[F.lit(_goes(m, turn)) for m in range(SELF)])


def _told(cells: DataFrame, sign: int) -> DataFrame:
    """What cells tell their neighbours: the bit that they are there, or with -1 that they are no more."""
    to = F.explode(F.array(*[F.struct((F.col("col") - dx).alias("col"), (F.col("row_no") - dy).alias("row_no"), F.lit(sign << j if sign > 0 else -(1 << j)).alias("bits")) for j, (dx, dy) in enumerate(AROUND)]))
    return cells.select("floor_id", to.alias("t")).select("floor_id", "t.col", "t.row_no", "t.bits")


def thinned(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Zhang-Suen thinning of masks (floor_id, col, row_no): the cells left, with ``mask``, their neighbours left, and ``free``, those of the given mask.

    ``sizes`` (floor_id, width, height): cells in the outermost columns and rows stay, and cells of floors without a size
    do. Each turn looks up every cell's neighbour bits; only the cells taken off tell their neighbours, by
    one aggregation that adds to the bits. A turn that takes nothing off costs no shuffle; two of them in a row end it.
    Turns are as many as the widest part of a mask is cells wide. Rows with nulls are left out, repeated ones count once.
    """
    whole = cells.select("floor_id", *[F.col(c).cast("long").alias(c) for c in KEY[1:]]).dropna().distinct()
    own = whole.select(*KEY, F.lit(SELF).alias("bits"))
    first = own.unionByName(_told(whole, 1)).groupBy(*KEY).agg(F.sum("bits").cast("int").alias("mask")).where(F.col("mask") >= SELF)
    known = sizes.dropna().groupBy("floor_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    inner = F.coalesce(F.col("col").between(1, F.col("width") - 2) & F.col("row_no").between(1, F.col("height") - 2), F.lit(False))
    now = first.join(known, "floor_id", "left").select(*KEY, "mask", F.col("mask").alias("free"), inner.alias("inner"))
    now, turn, idle = step(now, "mask"), 0, 0
    while True:
        goes = F.col("inner") & F.element_at(_table(turn), F.col("mask") - SELF + 1)
        off, stay = now.where(goes), now.where(~goes)
        idle = idle + 1 if off.isEmpty() else 0
        if idle == 2:
            return now.select(*KEY, (F.col("mask") - SELF).alias("mask"), (F.col("free") - SELF).alias("free"))
        if not idle:
            less = _told(off, -1).select(*KEY, F.col("bits").alias("mask"), F.lit(None).cast("int").alias("free"), F.lit(None).cast("boolean").alias("inner"))
            both = stay.unionByName(less).groupBy(*KEY).agg(F.sum("mask").cast("int").alias("mask"), F.max("free").alias("free"), F.max("inner").alias("inner"))
            then = step(both.where(F.col("free").isNotNull()), "mask")
            forget(now)
            now = then
        turn = 1 - turn


def links(left: DataFrame) -> DataFrame:
    """Neighbours among thinned cells (floor_id, ac, ar, bc, br), each pair once: sides first, corners only where both cells beside the step are free and neither is left."""
    bit = lambda name, j: F.col(name).bitwiseAND(1 << j) > 0
    corner = lambda j, side: bit("mask", j) & bit("free", 4) & bit("free", side) & ~bit("mask", 4) & ~bit("mask", side)
    ways = [(2, bit("mask", 2)), (4, bit("mask", 4)), (3, corner(3, 2)), (5, corner(5, 6))]
    to = F.filter(F.array(*[F.when(there, F.struct((F.col("col") + AROUND[j][0]).alias("bc"), (F.col("row_no") + AROUND[j][1]).alias("br"))) for j, there in ways]), lambda x: x.isNotNull())
    return left.select("floor_id", F.col("col").alias("ac"), F.col("row_no").alias("ar"), F.explode(to).alias("t")).select("floor_id", "ac", "ar", "t.bc", "t.br")


def longest_rows(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """The longest run of cells in a row of each floor, (floor_id, ac, ar, bc, br): of equal ones the nearest to the middle, then the upper, then the left one."""
    w = Window.partitionBy("floor_id", "row_no").orderBy("col")
    runs = cells.select(*KEY).withColumn("run", F.col("col") - F.row_number().over(w)).groupBy("floor_id", "row_no", "run").agg(F.min("col").alias("ac"), F.max("col").alias("bc"))
    runs = runs.where("bc > ac").join(sizes.groupBy("floor_id").agg(F.max("height").alias("height")), "floor_id", "left")
    order = F.struct(F.col("ac") - F.col("bc"), F.abs(F.col("row_no") - F.coalesce("height", F.lit(0)) / 2), "row_no", "ac")
    best = runs.groupBy("floor_id").agg(F.min_by(F.struct("ac", "bc", "row_no"), order).alias("r"))
    return best.select("floor_id", "r.ac", F.col("r.row_no").alias("ar"), "r.bc", F.col("r.row_no").alias("br"))


def graph_of_mask(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges (floor_id, ac, ar, bc, br, length) of the middle lines of masks, from cell to cell, straight runs as one edge; lengths in cells.

    A mask whose middle lines have no edge (a square thins to one cell) gives its longest row instead, if it has one of two cells.
    """
    left = step(thinned(cells, sizes), "thin")
    cell = lambda c, r: F.struct(F.col("floor_id").alias("f"), F.col(r).alias("r"), F.col(c).alias("c"))
    pairs = links(left)
    long = F.sqrt((F.abs(F.col("ac") - F.col("bc")) + F.abs(F.col("ar") - F.col("br"))).cast("double"))
    edges = step(pairs.select(F.struct("floor_id", "ar", "ac", "br", "bc").alias("edge_id"), cell("ac", "ar").alias("source"), cell("bc", "br").alias("target"), long.alias("length")), "links")
    # A line bends where the two steps away from a cell do not cancel out.
    away = lambda a, b: edges.select(F.col(a).alias("node_id"), (F.col(f"{b}.c") - F.col(f"{a}.c")).alias("dx"), (F.col(f"{b}.r") - F.col(f"{a}.r")).alias("dy"))
    bends = away("source", "target").unionByName(away("target", "source")).groupBy("node_id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy")).where("dx <> 0 or dy <> 0").select("node_id")
    straight = contract.merged(edges, bends)
    out = straight.select("source.f", F.col("source.c").alias("ac"), F.col("source.r").alias("ar"), F.col("target.c").alias("bc"), F.col("target.r").alias("br"), "length").withColumnRenamed("f", "floor_id")
    bare = cells.select(*KEY).dropna().distinct().join(edges.select(F.col("source.f").alias("floor_id")).distinct(), "floor_id", "left_anti")
    rows = longest_rows(bare, sizes).withColumn("length", (F.col("bc") - F.col("ac")).cast("double"))
    return reduce(DataFrame.unionByName, [out, rows])
