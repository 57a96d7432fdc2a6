"""Spanning forests against the walk in order."""

import random

from atrium.operators import graph


def test_forest_equals_the_walk_in_order(spark):
    rng = random.Random(9)
    for n, fixed, many in ((60, 15, 150), (40, 0, 30), (5, 4, 10)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(fixed)]
        pairs = sorted({(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(many)) if a != b})
        ranks = rng.sample(range(1000), len(pairs))
        at = list(range(n))

        def find(i):
            while at[i] != i:
                i = at[i]
            return i

        for a, b in edges:
            at[find(a)] = find(b)
        want = set()
        for _, (a, b) in sorted(zip(ranks, pairs, strict=True)):
            if find(a) != find(b):
                at[find(a)] = find(b)
                want.add((a, b))
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
        rows = [(a, b, r) for (a, b), r in zip(pairs, ranks, strict=True)]
        got = graph.spanning_forest(nodes, spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame(rows, "a long, b long, rank long"))
        assert {(r.a, r.b) for r in got.collect()} == want
