"""Joins of walks, sight and routes must not send what grows with the tables through the driver."""

import re

import pytest

from atrium.operators import floor, graph, spatial
from atrium.plans import coverage, network, simulation

SF = "/root/testdata/sf0.001"
#: What joins may be sent whole: one row a floor, and the fixed shapes.
SMALL = {"floor_id", "shape"}


@pytest.fixture
def sent(monkeypatch):
    """The keys of all broadcast joins that are planned, in steps too."""
    keys, write = [], graph.step

    def note(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys.extend({re.sub(r"#\d+L?", "", k) for k in m.split(", ")} for m in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan))
        return df

    for module in (floor, graph, spatial, coverage, network, simulation):
        monkeypatch.setattr(module, "step", lambda df, name="step": write(note(df), name))
    return keys, note


def large(keys):
    return [k for k in keys if not k <= SMALL]


def walk(spark):
    at = "floor_id long, seq long, edge_id long, forth boolean, ax double, ay double, bx double, by double, start_at double, end_at double, to_node long"
    return graph.step(spark.createDataFrame([(0, i + 1, i, True, 5.5 * i, 11.0, 5.5 * i + 5.5, 11.0, 5.5 * i, 5.5 * i + 5.5, i + 1) for i in range(8)], at), "walk")


def test_marks_of_walks_are_sorted_and_merged(spark, sent, monkeypatch):
    keys, note = sent
    segments = walk(spark)
    monkeypatch.setattr(simulation, "route_segments", lambda spark, d: segments)
    got = note(simulation.route_position_at(spark, SF))
    assert large(keys) == [] and got.count() == 8 * 22 + 1


def test_routes_are_sorted_and_merged_where_nodes_are_many(spark, sent, monkeypatch):
    keys, note = sent
    monkeypatch.setattr(graph, "SENT", 3)
    rows = [(i, i + 1, 1.0, 2.0, i) for i in range(40)]
    arcs = graph.step(spark.createDataFrame(rows + [(b, a, c, m, e) for a, b, c, m, e in rows], "a long, b long, cost double, distance double, edge_id long"), "arcs")
    got = note(graph.routes(spark.createDataFrame([(0, 0)], "source long, node_id long"), arcs))
    assert sorted((r.node_id, r.cost, r.path) for r in got.collect()) == [(i, float(i), list(range(i))) for i in range(41)]
    many = len(keys)
    # With few nodes a round the planner is free; 41 nodes take rounds of more and of fewer than three.
    monkeypatch.setattr(graph, "SENT", 0)
    keys.clear()
    note(graph.routes(spark.createDataFrame([(0, 0)], "source long, node_id long"), arcs)).count()
    assert keys == [] and many


def test_sight_of_points_is_sorted_and_merged(spark, sent):
    keys, note = sent
    got = note(simulation.handover_events(spark, SF, walk(spark)))
    assert large(keys) == [] and got.where("kind = 'connect'").count() > 0


def test_stretches_of_walks_are_sorted_and_merged(spark, sent, monkeypatch):
    keys, note = sent
    segments = walk(spark)
    monkeypatch.setattr(simulation, "route_segments", lambda spark, d: segments)
    got = note(simulation.coverage_sections(spark, SF))
    ends = got.selectExpr("min(start_at) as a", "max(end_at) as b", "round(sum(end_at - start_at), 6) as m").first()
    assert large(keys) == [] and tuple(ends) == (0.0, 44.0, 44.0)


def test_beacons_of_handovers_are_sorted_and_merged(spark, sent, monkeypatch):
    keys, note = sent
    events = graph.step(spark.createDataFrame([(0, 1.0, None, 3, "connect"), (0, 4.0, 3, 5, "handover"), (0, 6.0, 5, None, "lost")], "floor_id long, at double, from_beacon long, to_beacon long, kind string"), "events")
    monkeypatch.setattr(simulation, "handover_events", lambda spark, d: events)
    got = note(simulation.handover_stats(spark, SF))
    assert large(keys) == [] and [(r.handovers, r.connections, r.mean_metres) for r in got.collect()] == [(1, 2, 3.0)]
