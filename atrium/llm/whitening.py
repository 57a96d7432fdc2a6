"""Operator 11: whitening of embeddings by a covariance from squares of sums (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the contract: whole numbers of 1/1024, moved up by 100,000.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors that a task takes at a time.
ROWS = 4096
#: Largest absolute whole number; entries beyond it are held there, so that it fits a long.
MOST = 1 << 62
#: Part of the whole variance that a component must have to be told from none.
NO_VARIANCE = 1e-12
#: Exact sums travel in two parts: all above this many bits, and the rest.
LOW_BITS = 60


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows that count, their vectors as whole numbers), at most ROWS rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            column = batch.column(0)
            lists = column.flatten()
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = np.asarray(lists.cast(pa.float64()).to_numpy(zero_copy_only=False), float)
            good = length == size
            own = np.repeat(np.arange(len(length)), length)
            good[own[~np.isfinite(values)]] = False
            picked = np.floor(values[good[own]].reshape(-1, size) * SCALE) + SHIFT
            big = np.abs(picked) >= MOST
            x = np.where(big, 0, picked).astype(np.int64)
            x[big] = np.where(picked[big] > 0, MOST, -MOST)
            yield batch, np.flatnonzero(good), x


def _parts(values: list[int]) -> list[pa.Array]:
    """Whole numbers of any size as two decimals, so that sums of them stay exact."""
    cut = [(v >> LOW_BITS, v & ((1 << LOW_BITS) - 1)) for v in values]
    return [pa.array([x[k] for x in cut], pa.decimal128(38, 0)) for k in (0, 1)]


def _summed(rows: DataFrame, key: str) -> list[tuple[int, int]]:
    """(key, exact sum) of rows (key, hi, lo)."""
    out = rows.groupBy(key).agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    return [(r[0], (int(r[1]) << LOW_BITS) + int(r[2])) for r in out]


def _first_sums(size: int):
    """Per task the number of vectors (at index -1) and the sum of each dimension."""

    def run(batches):
        n, sums = 0, [0] * size
        for _, rows, x in _vectors(batches, size):
            if not len(rows):
                continue
            n += len(rows)
            wide = x if np.abs(x).max(initial=0) < MOST // ROWS else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, wide.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), *_parts([n, *sums])], ["i", "hi", "lo"])

    return run


def _squares(size: int, middle: list[int]):
    """Per task the sums of squares of every centred dimension and of every sum of two, as rows (pair, hi, lo)."""

    def run(batches):
        sums = np.zeros(size * size, object)
        for _, rows, x in _vectors(batches, size):
            if not len(rows):
                continue
            d = x.astype(object) - np.array(middle, object) if np.abs(x).max() > MOST >> 2 or max(map(abs, middle)) > MOST >> 2 else x - np.array(middle, np.int64)
            if 4 * int(np.abs(d).max()) ** 2 * len(d) >= MOST:
                d = d.astype(object)
            for i in range(size):
                both = d[:, i:] + d[:, i : i + 1]
                both[:, 0] = d[:, i]
                sums[i * size + i : (i + 1) * size] += (both * both).sum(axis=0).astype(object)
        at = [i * size + j for i in range(size) for j in range(i, size)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *_parts([int(sums[k]) for k in at])], ["pair", "hi", "lo"])

    return run


def covariance(n: int, sums: list[int], squares: dict[int, int]) -> np.ndarray:
    """Covariance (divisor n) from exact sums of squares, rounded once an entry.

    ``squares``: at i * size + j the sum of (d_i + d_j)^2, at i * size + i that of d_i^2, where d is x less the whole
    number under its mean. With r = S - n * that number, the sum of (n*d - r)^2 is n^2 * sum(d^2) - n * r^2 exactly; a
    pair's is the same of d_i + d_j and r_i + r_j. Then cov_ij = (Q_ij - Q_i - Q_j) / (2 n^3).
    """
    size = len(sums)
    r = [s - n * (s // n) for s in sums]
    alone = [n * n * squares[i * size + i] - n * r[i] ** 2 for i in range(size)]
    out = np.empty((size, size))
    for i in range(size):
        out[i, i] = alone[i] / n**3
        for j in range(i + 1, size):
            both = n * n * squares[i * size + j] - n * (r[i] + r[j]) ** 2
            out[i, j] = out[j, i] = (both - alone[i] - alone[j]) / (2 * n**3)
    return out


def _projected(size: int, n: int, sums: list[int], axes: np.ndarray, scale: list[float | None]):
    """Rows (carried id, deviation, w1 .. wk): exact squared distance from the mean, and the whitened projections."""

    def run(batches):
        centre = np.array(sums, object)
        for batch, rows, x in _vectors(batches, size):
            far = max((int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)), 1)
            y = x.astype(object) * n - centre if far >= MOST else x * n - centre.astype(np.int64)
            wide = y if int(np.abs(y).max(initial=0)) ** 2 * size < MOST else y.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]
            w = (y.astype(float) / n) @ axes
            ids = batch.column(1).take(pa.array(rows))
            white = [pa.array(w[:, k] / s) if s else pa.nulls(len(rows), pa.float64()) for k, s in enumerate(scale)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.int64()), *white], ["id", "deviation", *[f"w{k}" for k in range(len(scale))]])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """PCA whitening: one row per vector and component (id, component, n, deviation, whitened, explained, identity_error).

    An entry c becomes x = floor(1024 c) + 100000. One pass sums the dimensions exactly. A second sums, exactly, the
    squares of every centred dimension and of every sum of two; covariances follow as differences of these variances
    and are rounded once. Tasks send only such sums (size * (size + 1) / 2), Spark adds them up. ``eigh`` in the driver gives
    the components, numbered from 1 by falling eigenvalue e; ``whitened`` is x less the mean, on the component,
    over sqrt(e). ``deviation`` is the exact sum of (n*x - S)^2, null where it does not fit a long. ``identity_error`` is
    the largest absolute entry of the whitened columns' covariance minus the identity, taken from the rows returned.

    Left out: null vectors, vectors with null or non-finite entries, and vectors whose length is not the most
    frequent one (the longer of equally frequent ones). Entries beyond 2^62 count as 2^62. Vectors with fewer
    dimensions than ``components`` have as many components as dimensions. A component with at most 1e-12 of the whole
    variance (a single vector, equal vectors, dependent dimensions) has no scale: its whitened is null, it takes no part in
    identity_error, and explained is 0 if there is no variance at all; identity_error is then 0. Null and repeated ids
    keep a set of rows each. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector_col).alias("v"), F.col(id_col).alias("id"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usual = rows.where(F.col("v").isNotNull() & fine).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    out = f"{id_col} {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return spark.createDataFrame([], out)
    first = dict(_summed(rows.mapInArrow(_first_sums(size), "i int, hi decimal(38,0), lo decimal(38,0)"), "i"))
    n, sums = first[-1], [first[i] for i in range(size)]
    squares = dict(_summed(rows.mapInArrow(_squares(size, [s // n for s in sums]), "pair int, hi decimal(38,0), lo decimal(38,0)"), "pair"))
    cov = covariance(n, sums, squares)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(cov))
    scale = [float(np.sqrt(v)) if v > NO_VARIANCE * trace else None for v in values]
    columns = [f"w{k}" for k in range(len(scale))]
    kind = rows.schema["id"].dataType.simpleString()
    told = rows.mapInArrow(_projected(size, n, sums, axes, scale), f"id {kind}, deviation long, " + ", ".join(f"{c} double" for c in columns))
    told = materialize(told, "whitened")
    live = [c for c, s in zip(columns, scale, strict=True) if s]
    pairs = [(a, b) for i, a in enumerate(live) for b in live[i:]]
    error = 0.0
    if pairs:
        found = told.agg(*[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
        error = max(abs(found[k] - (a == b)) for k, (a, b) in enumerate(pairs))
    share = [float(v) / trace if trace > 0 else 0.0 for v in values]
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(c).alias("whitened"), F.lit(share[k]).alias("explained")) for k, c in enumerate(columns)])).alias("c")
    told = told.select(F.col("id").alias(id_col), "deviation", each)
    return told.select(id_col, "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
