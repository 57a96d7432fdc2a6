"""Whitening and near copies of vectors against plain versions, with nulls, odd lengths, ties, repeats and large groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.llm import vector_dedup, whitening

VEC = "vec_id long, embedding array<float>, label int, n int, whitened string, n_links string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, "x", "y", "z") for i, v in rows], VEC)


def brute(rows, threshold):
    """(n_links, component) of each row by all pairs."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = list(range(len(rows)))
    unit = [np.array(v, np.float32).astype(float) if ok else None for (_, v), ok in zip(rows, fine, strict=True)]
    unit = [u / np.linalg.norm(u / abs(u).max()) / abs(u).max() if u is not None else None for u in unit]

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                at[b] = a
    named = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (named.get(r), k) if x is not None]
        named[r] = min(ids) if ids else None
    return [(k, links[i], named[find(i)] if named[find(i)] is not None else k) for i, (k, _) in enumerate(rows)]


def clustered(rng, size=16):
    rows = [(None, [1.0] * size), (1, None), (2, []), (3, [0.0] * size), (4, [1.0] * (size - 1) + [None]), (5, [1.0] * (size - 1) + [float("nan")]), (6, [float("inf")] + [1.0] * (size - 1)), (7, [1.0] * (size + 1)), (8, [2.0] * (size + 1)), (9, [3e38] * size), (10, [1e-38] * size), (10, [5.0] * size), (11, [-1.0] * size)]
    for k in range(40):
        base = rng.standard_normal(size)
        for m in range(int(rng.integers(1, 9))):
            rows.append((100 + len(rows), (base + rng.standard_normal(size) * 0.28 * m / 8).tolist()))
        rows += [(100 + len(rows), rows[-1][1])] * (k % 3)
    random.Random(3).shuffle(rows)
    return rows


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    rows = clustered(np.random.default_rng(8))
    got = vector_dedup.near_copies(vectors(spark, rows), bucket=8, missed=1e-9).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute(rows, 0.9), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert max(r.n_links for r in got) > 5


def test_near_copies_in_a_bucket_of_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, (base + rng.standard_normal(8) * 0.35).tolist()) for i in range(300)] + [(1000 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    got = vector_dedup.near_copies(vectors(spark, rows), bucket=64, missed=1e-9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows, 0.9))


def test_tables_follow_from_the_pairs_that_may_be_missed():
    for n in (10, 10_000, 10**9):
        bits, tables = vector_dedup.shape(n, 0.9)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= vector_dedup.MISSED
        assert n / 2**bits <= vector_dedup.BUCKET


def test_near_copies_of_nothing_and_of_no_vectors(spark):
    assert vector_dedup.near_copies(vectors(spark, [])).count() == 0
    got = vector_dedup.near_copies(vectors(spark, [(1, None), (1, None), (None, [0.0])])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 0, 1, True)] * 2 + [(None, 0, None, True)], key=str)


def whole(rows, size):
    return [(k, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for k, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


def exact_covariance(x):
    """n^3 times the covariance, in whole numbers."""
    n, size = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(size)]
    y = [[n * r[i] - sums[i] for i in range(size)] for r in x]
    return y, [[sum(r[i] * r[j] for r in y) for j in range(size)] for i in range(size)]


@pytest.mark.parametrize("far", [0.0, 3000.0, 1e9])
def test_whitening_equals_a_plain_one(spark, far):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((10, 10))
    rows = [(i, (rng.standard_normal(10) @ mix + far * (i % 7 == 0)).tolist()) for i in range(200)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (900, None), (901, []), (902, [1.0] * 9), (903, [1.0] * 9 + [None]), (904, [float("nan")] * 10), (905, [float("-inf")] * 10)]
    kept = whole(rows, 10)
    n = len(kept)
    y, cov = exact_covariance([x for _, x in kept])
    v = np.array([[c / n**3 for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    if far < 1e6:
        assert all(r.identity_error < 1e-4 for r in got)
        want = sorted(((k, sum(c * c for c in r)) for (k, _), r in zip(kept, y, strict=True)), key=str)
        assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == want
    for r in got[:8]:
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * values[r.component - 1] / values.sum() + 1e-12
    axes = np.linalg.eigh(v)[1][:, ::-1]
    for k in range(1, 4):
        plain = {i: (np.array(r, float) / n) @ axes[:, k - 1] / math.sqrt(values[k - 1]) for (i, _), r in zip(kept, y, strict=True)}
        own = {r.vec_id: r.whitened for r in got if r.component == k}
        if own[1] is None:
            assert far > 1e6 and k > 1
            continue
        sign = np.sign(plain[1] * own[1])
        assert far > 1e6 or all(abs(sign * own[i] - plain[i]) < 1e-6 for i in plain)


def test_covariance_from_squares_of_sums_is_the_exact_one():
    rng = random.Random(1)
    x = [[rng.randrange(-(10**12), 10**12) if j else 7 * i for j in range(4)] for i in range(30)]
    n, sums = len(x), [sum(r[i] for r in x) for i in range(4)]
    d = [[c - s // n for c, s in zip(r, sums, strict=True)] for r in x]
    squares = {i * 4 + j: sum((r[i] + r[j]) ** 2 if i != j else r[i] ** 2 for r in d) for i in range(4) for j in range(i, 4)}
    _, cov = exact_covariance(x)
    assert whitening.covariance(n, sums, squares).tolist() == [[c / n**3 for c in r] for r in cov]


def test_whitening_without_variance_and_of_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(i, c, 2, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in flat)


def test_wide_vectors_of_doubles(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i // 2).standard_normal(3)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_copies(df, threshold=0.999).collect()}
    assert all(n >= 1 for n in got.values())
    assert whitening.whiten(df.withColumn("i", F.lit(1))).count() == 60
