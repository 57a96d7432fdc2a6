"""Operator 12: near copies of embeddings by sign hashes, exact cosines and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, salted_left_join

#: Part of the pairs right at the threshold that no table may bring together.
MISSED = 1e-4
#: Vectors that a bucket holds on average where they are spread evenly.
BUCKET = 512
LEAST_BITS = 8
#: Vectors of a bucket that meet at a time.
BLOCK = 1024
#: Vectors that are hashed at a time, and rows of units that are made at a time.
ROWS = 1024
UNITS = 4096
SEED = 20

CLASS = "node long, copies long, vector binary, size int"
UNIT = "size int, t int, code long, i int, j int, part int, node long, copies long, vector binary, codes binary"


def shape(n: int, threshold: float, missed: float = MISSED, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a hash, tables): a pair at the threshold shares a bit with probability 1 - angle/pi, and must share a hash in some table."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n / bucket))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log1p(-together)))


def _packed(kind: str):
    """(id, vector as bytes of its own kind of numbers, size); the vector is null where it is null, empty, all zero or has null or non-finite entries."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), kind)
            own = np.repeat(np.arange(len(length)), length)
            good = np.bincount(own, weights=values != 0, minlength=len(length)) > 0
            good[own[~np.isfinite(values)]] = False
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
            packed = [values[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(np.where(good, length, 0).astype(np.int32))], ["id", "vector", "size"])

    return run


def _units_of(vectors: list[bytes], size: int) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in doubles."""
    packed = b"".join(vectors)
    x = np.frombuffer(packed, "f4" if len(packed) == 4 * size * len(vectors) else "f8").reshape(len(vectors), size).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, size)).standard_normal((size, tables * bits))


def _kind(bits: int) -> str:
    return "i2" if bits < 16 else "i4" if bits < 32 else "i8"


def _codes(bits: int, tables: int):
    """Adds each class's hash in every table, as the bytes of integers."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                size = batch.column(3).to_numpy()
                vectors, out = batch.column(2).to_pylist(), [b""] * batch.num_rows
                for d in np.unique(size).tolist():
                    rows = np.flatnonzero(size == d)
                    if d not in planes:
                        planes[d] = _planes(d, bits, tables)
                    signs = (_units_of([vectors[i] for i in rows], d) @ planes[d] >= 0).reshape(len(rows), tables, bits)
                    codes = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2).astype(_kind(bits))
                    for k, i in enumerate(rows.tolist()):
                        out[i] = codes[k].tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "codes"])

    return run


def _buckets(bits: int, tables: int):
    """(size, t, code, node) for each class and table."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                k = batch.num_rows
                codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), _kind(bits)).astype(np.int64)
                t = np.tile(np.arange(tables, dtype=np.int32), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(3).to_numpy(), tables)), pa.array(t), pa.array(codes), pa.array(np.repeat(batch.column(0).to_numpy(), tables))], ["size", "t", "code", "node"])

    return run


def _dealt(bits: int, tables: int):
    """Each class once for every unit it takes part in: a bucket, or two parts of a bucket that is cut in parts."""

    def units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, t, i, j, part), some thousands at a time."""
        cut = batch.column(5)
        parts = np.ones((batch.num_rows, tables), np.int64)
        flat = cut.flatten()
        if len(flat):
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))
            parts[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        own = batch.column(0).to_numpy()[:, None] % parts
        row, t = (x.ravel() for x in np.indices(parts.shape, np.int32))
        parts, own = parts.ravel(), own.ravel().astype(np.int32)
        ends = np.cumsum(parts)
        for at in range(0, int(ends[-1]) if len(ends) else 0, UNITS):
            number = np.arange(at, min(int(ends[-1]), at + UNITS))
            k = np.searchsorted(ends, number, side="right")
            other = (number - (ends - parts)[k]).astype(np.int32)
            yield row[k], t[k], np.minimum(own[k], other), np.maximum(own[k], other), own[k]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), _kind(bits)).reshape(batch.num_rows, -1).astype(np.int64)
                for row, t, i, j, part in units(batch):
                    take = lambda c, batch=batch, row=row: batch.column(c).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([take(3), pa.array(t), pa.array(codes[row, t]), pa.array(i), pa.array(j), pa.array(part), take(0), take(1), take(2), take(4)], [x.split()[0] for x in UNIT.split(", ")])

    return run


def _meet(threshold: float, bits: int):
    """Of one unit: for each class with links found here first, (node, other, links): a class of its group within the unit, and its partners' copies."""

    def run(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
        size, t, _, i, j = (k.as_py() for k in key)
        node, part = unit.column("node").to_numpy(), unit.column("part").to_numpy()
        order = np.lexsort((node, part))
        node, part, copies = node[order], part[order], unit.column("copies").to_numpy()[order]
        vectors = unit.column("vector").to_pylist()
        x = _units_of([vectors[k] for k in order], size)
        split = int(np.searchsorted(part, j)) if i < j else len(node)
        left, right = (slice(0, split), slice(split, len(node))) if i < j else (slice(0, split), slice(0, split))
        linked = x[left] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        a, b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, a, b = linked[np.ix_(a, b)], a + left.start, b + right.start
        codes = unit.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(codes[k] for k in order), _kind(bits)).reshape(len(order), -1)
        for earlier in range(t):
            if not linked.any():
                break
            linked &= codes[a, earlier][:, None] != codes[b, earlier][None, :]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, linked @ copies[b])
        if i < j:
            np.add.at(links, b, copies[a] @ linked)
        label = np.arange(len(node))
        while len(a) and len(b):
            was = label.copy()
            np.minimum.at(label, a, np.where(linked, label[b][None, :], len(node)).min(axis=1))
            np.minimum.at(label, b, np.where(linked, label[a][:, None], len(node)).min(axis=0))
            label = label[label]
            if (label == was).all():
                break
        found = np.flatnonzero(links)
        return pa.table({"node": node[found], "other": node[label[found]], "links": links[found]})

    return run


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, missed: float = MISSED, bucket: int = BUCKET) -> DataFrame:
    """Links of vectors with cosine >= threshold: one row per input row (id, n_links, component_id, kept).

    Equal vectors become one class with its number of copies. Each class is hashed by the signs of its products with
    random planes, in several tables; bits follow from the number of classes (``bucket`` classes to a bucket), tables
    from the part of pairs at the threshold that may be missed (pairs above it are missed more rarely). Classes that
    share a hash meet there and their cosine is computed in doubles; no pair below the threshold links. A
    bucket of more than 1,024 classes is cut in parts, and each two parts meet in a task of their own. Of a
    bucket come, for each class, the copies it links with and one class of its group, not its pairs; a pair counts in
    the first table that it shares. Components come from these links, distributed.

    ``n_links`` counts other rows linked directly, equal vectors included; ``component_id`` is the least id reachable
    by links; ``kept`` tells that it is the row's own. Vectors that are null, empty, all zero, or hold null or
    non-finite entries link with nothing and are their own component; so do vectors of different lengths among each
    other. A null id takes part but names a component only if all ids in it are null; it is kept only then.
    Rows that repeat an id are separate rows. Other columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "f8"
    packed = rows.mapInArrow(_packed(kind), "id long, vector binary, size int")
    packed = materialize(packed.withColumn("digest", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64(F.lit(1), "vector").alias("h"), F.xxhash64(F.lit(2), "vector").alias("k")))), "packed")
    grouped = packed.where("vector is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"), F.first("size").alias("size"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables = shape(classes.count(), threshold, missed, bucket)
    hashed = materialize(classes.select("node", "copies", "vector", "size").mapInArrow(_codes(bits, tables), CLASS + ", codes binary"), "codes")
    buckets = hashed.mapInArrow(_buckets(bits, tables), "size int, t int, code long, node long")
    buckets = materialize(buckets, "buckets")
    large = buckets.groupBy("size", "t", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = materialize(large.select("size", "t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "large")
    cut = salted_left_join(buckets, large, ["size", "t", "code"], F.col("node")).where("parts is not null")
    cut = cut.groupBy("node").agg(F.collect_list(F.struct("t", "parts")).alias("cut"))
    units = hashed.join(cut, "node", "left").mapInArrow(_dealt(bits, tables), UNIT)
    found = materialize(units.groupBy("size", "t", "code", "i", "j").applyInArrow(_meet(threshold, bits), "node long, other long, links long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    named = classes.select("node", "digest", "copies", "least").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component"))
    named = salted_left_join(named, names, ["label"], F.col("node"), 4).select("digest", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = salted_left_join(packed.select("id", "digest"), named, ["digest"], F.col("id"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
