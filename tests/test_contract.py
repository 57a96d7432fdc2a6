"""Chains, pruning and contraction against plain walks."""

import random

import pytest

from atrium.operators import contract

SCHEMA = "edge_id long, source long, target long, length double, note string"


def graphs():
    rng = random.Random(4)
    yield [(i, i, i + 1, 1.0 + i % 3) for i in range(60)], set()  # one line
    yield [(i + 5, (i + 3) % 7, (i + 4) % 7, 1.0) for i in range(7)], set()  # a ring
    yield [(1, 1, 1, 2.0), (2, 3, 4, 1.0), (3, 4, 3, 1.5), (4, 4, 9, 0.5), (5, 20, 21, 0.25), (6, 20, 21, 1.0)], {9}
    for n, m in ((12, 11), (30, 30), (60, 62), (80, 70)):
        edges = [(i, rng.randrange(n), rng.randrange(n), rng.randrange(1, 16) / 4) for i in range(m)]
        yield edges, set(rng.sample(range(n), n // 8))


def plain_chains(edges, stops):
    leaving = {}
    for e, a, b, w in edges:
        leaving.setdefault(a, []).append((e, False, b, w))
        leaving.setdefault(b, []).append((e, True, a, w))
    through = {v for v, ds in leaving.items() if len(ds) == 2 and v not in stops}
    seen, out = set(), []

    def walk(a, dart):
        path = []
        while True:
            e, back, b, w = dart
            if e in seen:
                break
            seen.add(e)
            path.append((e, a, b, w))
            if b not in through:
                break
            dart = next(d for d in leaving[b] if (d[0], d[1]) != (e, not back))
            a = b
        return path

    for v in sorted(leaving):
        if v not in through:
            for dart in sorted(leaving[v]):
                if dart[0] not in seen:
                    out.append((walk(v, dart), False))
    for e, a, b, w in sorted(edges):
        if e not in seen:
            out.append((walk(a, (e, False, b, w)), True))
    return out


def plain_pruned(edges, keep):
    edges = list(edges)
    while True:
        degree = {}
        for _, a, b, _ in edges:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        left = [e for e in edges if not any(degree[v] == 1 and v not in keep for v in e[1:3])]
        if len(left) == len(edges):
            return {e[0] for e in edges}
        edges = left


def plain_contracted(edges, shortest, keep):
    edges = [list(e) for e in sorted(edges)]
    into = []
    while True:
        tiny = next((e for e in edges if e[3] < shortest and e[1] != e[2] and not {e[1], e[2]} & keep), None)
        if tiny is None:
            return {tuple(e) for e in edges}, set(into)
        edges.remove(tiny)
        _, a, b, w = tiny
        into.append((b, a, tiny[0]))
        for e in edges:
            for k in (1, 2):
                if e[k] == b:
                    e[k] = a
                    e[3] += w


def table(spark, edges):
    return spark.createDataFrame([(*e, "x") for e in edges], SCHEMA)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in sorted(ids)], "node_id long")


@pytest.mark.parametrize("k", range(7))
def test_chains_pruning_and_contraction(spark, k):
    edges, stops = list(graphs())[k]
    want = {}
    for path, closed in plain_chains(edges, stops):
        name, at = min(e for e, *_ in path), 0.0
        for i, (e, a, b, w) in enumerate(path):
            want[e] = (name, i, a, b, w, at, len(path), closed)
            at += w
    got = contract.chains(table(spark, edges), nodes(spark, stops)).collect()
    assert {r.edge_id: (r.chain, r.seq, r.a, r.b, r.length, r.offset, r.edges, r.closed) for r in got} == want and len(got) == len(want)
    left = contract.pruned(table(spark, edges), nodes(spark, stops)).collect()
    assert {r.edge_id for r in left} == plain_pruned(edges, stops)
    now, into = contract.contracted(table(spark, edges), 1.5, nodes(spark, stops))
    want_now, want_into = plain_contracted(edges, 1.5, stops)
    assert {(r.edge_id, r.source, r.target, r.length) for r in now.collect()} == want_now
    assert {(r.node_id, r.into, r.edge_id) for r in into.collect()} == want_into


def test_missing_repeated_and_no_rows(spark):
    rows = [(1, 1, 2, None, "a"), (1, 1, 2, None, "b"), (2, 2, 3, float("nan"), None), (None, 3, 4, 1.0, ""), (3, None, 4, 1.0, ""), (4, 4, None, 1.0, "")]
    got = contract.chains(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.chain, r.seq, r.edge_id, r.offset) for r in got) == [(1, 0, 1, 0.0), (1, 1, 2, 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert contract.chains(none).count() == 0 and contract.pruned(none).count() == 0
    now, into = contract.contracted(none, 1.0)
    assert now.count() == 0 and into.count() == 0


def test_long_chains_are_added_up_in_blocks(spark):
    rows = spark.range(1000).selectExpr("1 as g", "id as seq", "cast(id as double) as v")
    got = contract.prefix_sums(rows, ["g"], "seq", "v", "before", block=64).collect()
    assert all(r.before == r.seq * (r.seq - 1) / 2 for r in got) and len(got) == 1000
