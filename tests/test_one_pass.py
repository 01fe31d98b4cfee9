"""Queries that read their input once, whatever they put together from it."""

import pytest

from loopmill.operators import network
from loopmill.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["route_tcx", "turn_table"])
def test_lines_are_read_once(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["trail_edge_counts", "trail_targets"])
def test_lines_are_read_once_over_all_jobs(spark, monkeypatch, name):
    from loopmill.operators import graph

    read, settled = [], graph.settled

    def lines_of(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines())

    def seen(df, *args, **kwargs):
        read.append(lines_of(df))
        return settled(df, *args, **kwargs)

    monkeypatch.setattr(graph, "settled", seen)
    found = registry.QUERIES[name](spark, SMALL)
    assert sum(read) + lines_of(found) == 1


def test_edges_made_of_steps_are_those_of_ways(spark):
    every = {(e.way_id, e.from_id, e.to_id): (e.is_trail, e.distance) for e in registry.parts(spark, SMALL)[2].collect()}
    trails = {(e.way_id, e.from_id, e.to_id): (e.is_trail, e.distance) for e in registry.trail_edges(spark, SMALL).collect()}
    near = {(e.way_id, e.from_id, e.to_id): (e.is_trail, e.distance) for e in registry.target_edges(spark, SMALL).collect()}
    assert trails == {k: v for k, v in every.items() if v[0]} and trails
    assert near == {k: v for k, v in every.items() if v[0] or v[1] <= registry.TARGET_M + 1}


def test_distances_leave_out_edges_beyond_the_reach(spark):
    from loopmill.operators import graph

    edges = spark.createDataFrame([(0, 1, 90.0), (0, 1, 40.0), (1, 2, 60.0), (0, 2, 101.0), (2, 3, 0.5)], "from_id long, to_id long, distance double")
    starts = spark.createDataFrame([(7, 0)], "request_id long, node_id long")
    assert {(r.node_id, r.metres) for r in graph.network_distances(starts, edges, 100.0).collect()} == {(0, 0.0), (1, 40.0), (2, 100.0)}


def test_transitions_are_counted_as_pairs_are(spark):
    nodes = spark.createDataFrame([(k, 40.0 + 0.001 * k, -75.0 + 0.002 * (k % 3), k == 2) for k in range(6)], "node_id long, lat double, lon double, has_signal boolean")
    # repeated segments, a busy road over a signal and over none, a lonely way
    ways = [(1, [0, 1, 2, 0], False, "footway"), (2, [1, 3, 1], True, "primary"), (3, [2, 3], False, "track"), (4, [4, 5], False, "track"), (5, [2, 1], True, "primary")]
    rows = [(w, f"Street {w}", False, busy, kind, i, a, b) for w, refs, busy, kind in ways for i, (a, b) in enumerate(zip(refs, refs[1:]))]
    segments = spark.createDataFrame(rows, "way_id long, name string, is_trail boolean, is_busy boolean, highway string, pos int, a long, b long")
    edges = network.build_edges(segments, nodes)
    e = edges.collect()
    busy = {x.from_id for x in e if x.is_busy}
    want = {}
    for x in e:
        for y in e:
            if x.to_id == y.from_id:
                n, u, s = want.get(x.highway, (0, 0, 0))
                unsafe = x.to_id in busy and x.to_id != 2 and not x.is_busy and not y.is_busy
                want[x.highway] = (n + 1, u + (y.edge_key == x.reverse_key), s + unsafe)
    got = {r.highway: (r.n, r.u_turns, r.unsafe) for r in network.transition_counts(edges, nodes).collect()}
    assert got == want and any(s for _, _, s in want.values())
