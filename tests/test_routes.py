"""Routes far longer than a round, and routes of one cost and several lengths."""

from atrium.operators import graph

ARC = "a long, b long, cost double, distance double, edge_id long"
START = "source long, node_id long"


def test_rounds_follow_the_logarithm_of_the_longest_route(spark, monkeypatch):
    arcs = spark.createDataFrame([(i, i + 1, 1.0, 2.0, i) for i in range(1000)] + [(i + 1, i, 1.0, 2.0, i) for i in range(1000)], ARC)
    steps, write = [], graph.step
    monkeypatch.setattr(graph, "step", lambda df, name="step": steps.append(name) or write(df, name))
    got = graph.routes(spark.createDataFrame([(0, 0)], START), arcs).select("node_id", "cost", "distance").collect()
    assert sorted(map(tuple, got)) == [(i, float(i), 2.0 * i) for i in range(1001)]
    assert len(steps) < 100


def test_lengths_are_those_of_the_least_path(spark):
    # Two ways of one cost to node 3: edges 5, 6 of length 9 each and edges 2, 7 of length 4 each; edge 9 goes on from there.
    arcs = spark.createDataFrame([(0, 1, 1.0, 9.0, 5), (1, 3, 1.0, 9.0, 6), (0, 2, 1.0, 4.0, 2), (2, 3, 1.0, 4.0, 7), (3, 4, 0.5, 1.0, 9), (7, 8, 1.0, 1.0, 8)], ARC)
    got = graph.lengths(spark.createDataFrame([(0, 0)], START), arcs).collect()
    assert sorted((r.node_id, r.cost, r.distance) for r in got) == [(0, 0.0, 0.0), (1, 1.0, 9.0), (2, 1.0, 4.0), (3, 2.0, 8.0), (4, 2.5, 9.0)]
