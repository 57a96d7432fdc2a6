"""Small rasters: each 64-value vector is an 8 x 8 image, ink where the value is below zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import graph, spatial
from atrium.plans.query import Query
from atrium.sources.derive import base

WIDTH = 8


def pixels(spark, d) -> DataFrame:
    e = base(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.pmod("i", F.lit(WIDTH)).cast("long").alias("col"), F.floor(F.col("i") / WIDTH).alias("row_no"), (F.col("v") < 0).alias("ink"))


def raster_ink_count(spark, d) -> DataFrame:
    return pixels(spark, d).groupBy("vec_id").agg(F.count_if("ink").alias("ink"), F.count(F.lit(1)).alias("pixels"))


def raster_runs(spark, d) -> DataFrame:
    """Runs of ink in each row."""
    runs = spatial.islands(pixels(spark, d), ["vec_id", "row_no"], ["col"], "ink")
    return runs.where("ink").groupBy("vec_id", "row_no", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("island")


def raster_boundary_edges(spark, d) -> DataFrame:
    """Sides between ink and paper, the image's outside being paper."""
    p = pixels(spark, d).where("ink").select("vec_id", "col", "row_no")
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(s).alias("side")) for x, y, s in ((1, 0, "right"), (-1, 0, "left"), (0, 1, "below"), (0, -1, "above"))]))
    near = p.withColumn("s", step).select("vec_id", "col", "row_no", (F.col("col") + F.col("s.dx")).alias("c2"), (F.col("row_no") + F.col("s.dy")).alias("r2"), F.col("s.side").alias("side"))
    ink = p.select("vec_id", F.col("col").alias("c2"), F.col("row_no").alias("r2"))
    return near.join(ink, ["vec_id", "c2", "r2"], "left_anti").groupBy("vec_id", "side").agg(F.count(F.lit(1)).alias("n"))


def raster_closed(spark, d) -> DataFrame:
    """Ink after a 4-neighbour close: grown by one pixel, then shrunk by one (outside counts as ink)."""
    p = pixels(spark, d).where("ink").select("vec_id", "col", "row_no")
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    to = lambda df: df.withColumn("m", moves).select("vec_id", (F.col("col") + F.col("m.dx")).alias("col"), (F.col("row_no") + F.col("m.dy")).alias("row_no")).where(f"col between 0 and {WIDTH - 1} and row_no between 0 and {WIDTH - 1}")
    grown = to(p).distinct()
    paper = pixels(spark, d).select("vec_id", "col", "row_no").join(grown, ["vec_id", "col", "row_no"], "left_anti")
    return grown.join(to(paper), ["vec_id", "col", "row_no"], "left_anti").groupBy("vec_id").agg(F.count(F.lit(1)).alias("ink"))


def raster_components(spark, d) -> DataFrame:
    """4-neighbour groups of ink: number and largest, per image."""
    cells = pixels(spark, d).where("ink").select(F.col("vec_id").alias("floor_id"), "col", "row_no", F.col("col").alias("x"), F.col("row_no").alias("y"))
    sizes = graph.grid_components(cells).groupBy("floor_id", "zone_col", "zone_row").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.col("floor_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


PIXEL_SQL = "px AS (SELECT vec_id, CAST(i % 8 AS bigint) AS col, CAST(floor(i / 8) AS bigint) AS row_no, embedding[i + 1] < 0 AS ink FROM embeddings, range(64) t(i))"
QUERIES = {
    "raster_ink_count": Query(raster_ink_count, f"WITH {PIXEL_SQL} SELECT vec_id, count(*) FILTER (ink) AS ink, count(*) AS pixels FROM px GROUP BY vec_id"),
    "raster_runs": Query(raster_runs, f"""WITH {PIXEL_SQL}, g AS (SELECT *, col - row_number() OVER (PARTITION BY vec_id, row_no ORDER BY col) AS grp FROM px WHERE ink)
        SELECT vec_id, row_no, min(col) AS first_col, max(col) AS last_col FROM g GROUP BY vec_id, row_no, grp"""),
    "raster_boundary_edges": Query(raster_boundary_edges, f"""WITH {PIXEL_SQL}, ink AS (SELECT * FROM px WHERE ink), m(dx, dy, side) AS (VALUES (1, 0, 'right'), (-1, 0, 'left'), (0, 1, 'below'), (0, -1, 'above'))
        SELECT a.vec_id, side, count(*) AS n FROM ink a, m WHERE NOT EXISTS (SELECT 1 FROM ink b WHERE b.vec_id = a.vec_id AND b.col = a.col + dx AND b.row_no = a.row_no + dy) GROUP BY a.vec_id, side"""),
    "raster_closed": Query(raster_closed, f"""WITH {PIXEL_SQL}, m(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
        grown AS (SELECT p.vec_id, p.col, p.row_no, EXISTS (SELECT 1 FROM px q, m WHERE q.ink AND q.vec_id = p.vec_id AND q.col = p.col + dx AND q.row_no = p.row_no + dy) AS ink FROM px p)
        SELECT vec_id, count(*) AS ink FROM grown p WHERE NOT EXISTS (SELECT 1 FROM grown q, m WHERE NOT q.ink AND q.vec_id = p.vec_id AND q.col = p.col + dx AND q.row_no = p.row_no + dy) GROUP BY vec_id"""),
    "raster_components": Query(raster_components, f"""WITH RECURSIVE {PIXEL_SQL}, ink AS (SELECT vec_id, vec_id * 1000000 + row_no * 1000 + col AS id FROM px WHERE ink),
        link AS (SELECT a.id AS s, b.id AS t FROM (SELECT id, id + k AS at FROM ink, (VALUES (1), (-1), (1000), (-1000)) v(k)) a JOIN ink b ON b.id = a.at),
        lab(id, label) USING KEY (id) AS (SELECT id, id FROM ink
          UNION SELECT l.t, min(r.label) FROM lab r JOIN link l ON l.s = r.id JOIN recurring.lab o ON o.id = l.t WHERE r.label < o.label GROUP BY l.t),
        sizes AS (SELECT vec_id, label, count(*) AS n FROM ink JOIN lab USING (id) GROUP BY vec_id, label)
        SELECT vec_id, count(*) AS components, max(n) AS largest FROM sizes GROUP BY vec_id"""),
}
