import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loopmill.functions import draws, geo, text
from loopmill.functions import tags as T
from loopmill.operators import choice, folds, graph, network, places, routes, spatial
from loopmill.plans import registry
from loopmill.sources import sinks, tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "events", "supplier"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["network_summary", "turn_table", "route_summary", "route_checks", "nearest_nodes", "best_results", "geocoded_requests", "address_suggestions", "route_tcx", "snapped_points", "split_streets", "seeds_compared", "elevation_choice", "search_stats", "route_laps", "town_turns", "town_split", "trail_clusters", "dead_ends", "bridge_links", "start_distances", "town_walks", "town_paths", "town_returns", "town_loops", "town_waypoints", "town_targets", "town_edge_sets", "town_edge_counts", "town_hulls", "town_payload", "crossing_tags", "route_choice", "route_arrows", "route_points_kept", "route_track", "route_thumbnails", "seeded_draws", "route_gpx"])
def test_against_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE[name]).df()
    key = lambda d: sorted((tuple(None if v is None or v != v else round(float(v), 4) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_entry_and_columns(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_tag_rules(spark):
    rows = [({"highway": "service", "name": "A", "service": "parking_aisle"}, False), ({"highway": "service"}, False), ({"highway": "service", "name": "B"}, True), ({"access": "private", "foot": "yes", "highway": "residential"}, True), ({"access": "private"}, False), (None, True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, tags map<string,string>")
    got = [r.k for r in df.orderBy("i").select(T.is_kept(F.col("tags")).alias("k")).collect()]
    assert got == [k for _, k in rows]


def test_read_osm_last_node_wins_and_short_segments_go(spark, tmp_path):
    e = [{"type": "node", "id": 1, "lat": 0.0, "lon": 0.0}, {"type": "node", "id": 1, "lat": 0.0, "lon": 1.0}, {"type": "node", "id": 2, "lat": 0.0, "lon": 1.001}, {"type": "node", "id": 3, "lat": 0.0, "lon": 1.001}, {"type": "way", "id": 7, "nodes": [1, 2, 3, 9], "tags": {"highway": "path"}}, {"type": "relation", "id": 5}]
    (tmp_path / "x.json").write_text(json.dumps({"elements": e}))
    nodes, ways = tables.read_osm(spark, str(tmp_path / "x.json"))
    seg = network.way_segments(ways)
    edges = network.build_edges(seg, nodes).collect()
    assert sorted(x.edge_key for x in edges) == ["7:1>2", "7:2>1"]
    assert {x.node_id: x.degree for x in network.build_nodes(seg, network.build_edges(seg, nodes), nodes).collect()} == {1: 1, 2: 1, 3: 0}


def test_turn_limits(spark):
    df = spark.createDataFrame([(0.0,), (24.9,), (25.0,), (45.0,), (120.0,), (180.0,)], "a double")
    assert [r.t for r in df.select(geo.turn_kind(F.col("a"), F.lit(False)).alias("t")).collect()] == ["straight", "straight", "slight", "turn", "sharp", "sharp"]


def test_draws_are_uniform_and_stable(spark):
    u = [r.u for r in spark.range(1, 2001).select(draws.uniform(F.lit(42), F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03 and len(set(u)) == len(u)


def links(spark, pairs):
    return spark.createDataFrame([(i, a, b, 10.0) for i, (a, b) in enumerate(pairs)], "way_id long, u long, v long, distance double")


def test_dead_ends_and_components(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (6, 7), (6, 7), (8, 9)]  # triangle with a tail, a pair of parallel ways, a lone link
    g = links(spark, pairs)
    assert sorted((r.u, r.v) for r in graph.dead_end_spurs(g).collect()) == [(3, 4), (4, 5), (8, 9)]
    assert {r.node_id: r.cluster_id for r in graph.components(g).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8}


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 4, 100.0)], "from_id long, to_id long, distance double")
    s = spark.createDataFrame([(0, 1)], "request_id long, node_id long")
    assert {r.node_id: r.metres for r in graph.network_distances(s, e, 50.0).collect()} == {1: 0.0, 2: 5.0, 3: 10.0}


def test_nearest_node_far_and_ties(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "point_id long, lat double, lon double")
    n = spark.createDataFrame([(5, 0.0, 0.001), (4, 0.0, -0.001), (6, 1.0, 1.0)], "node_id long, lat double, lon double")
    assert {r.point_id: r.node_id for r in spatial.nearest_node(p, n).collect()} == {1: 4, 2: 6}


def test_folds_against_loops(spark):
    steps = tables.order_routes(spark, DATA)
    got = {}
    for r in folds.decimated_points(steps).where("step >= 0").collect():
        got.setdefault(r.route_id, []).append(r.step)
    rows = sorted((r.route_id, r.step, r.distance) for r in routes.measured(steps).collect())
    want, n = {}, {}
    for i, (route, step, d) in enumerate(rows):
        n[route] = n.get(route, math.inf) + d
        if n[route] >= 25 or i + 1 == len(rows) or rows[i + 1][0] != route:
            want.setdefault(route, []).append(step)
            n[route] = 0.0
    assert {k: sorted(v) for k, v in got.items()} == want


def test_geocode_reasons(spark):
    g = spark.createDataFrame([("main st", 0, "1", "2", "A", None), ("Main  St", 1, "3", "4", "B", "9"), ("9 main st", 0, "x", "4", "C", "")], "address string, rank int, lat string, lon string, display_name string, house_number string")
    r = spark.createDataFrame([(1, " MAIN st"), (2, "9 Main St"), (3, "nowhere"), (4, None)], "request_id int, address string")
    got = {x.request_id: (x.display_name, x.reason) for x in places.geocode(r, g).collect()}
    assert got == {1: ("A", None), 2: (None, "no_house_number"), 3: (None, "not_found"), 4: (None, "not_found")}


def test_suggestion_label(spark):
    rows = [("1", "A St", "N", "Town", "C", "S", "L"), (None, "A St", "N", "A St", "C", "S", "L"), (None, None, "N", None, None, "S", "L"), ("", "", "", "", "", "", ""), ("1", None, "N", None, "C", None, "L")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, s string, m string, t string, c string, a string, l string")
    got = [r.x for r in df.orderBy("i").select(text.suggestion_label(*(F.col(c) for c in "nsmtcal")).alias("x")).collect()]
    assert got == ["1 A St, Town, S", "A St, C, S", "N, S, L", "", "N, C"]


def test_snap_far_ends_and_many_on_one_segment(spark):
    seg = spark.createDataFrame([(7, 1, 2, 0.0, 0.0, 0.0, 0.004)], "way_id long, a long, b long, lat1 double, lon1 double, lat2 double, lon2 double")
    p = spark.createDataFrame([(1, 0.0001, 0.001), (2, -0.0001, 0.003), (3, 40.0, -30.0), (4, 0.0, 0.00399), (5, None, 0.0)], "point_id long, lat double, lon double")
    s = places.snap_to_network(p, seg)
    assert {r.point_id: r.node_id for r in s.collect()} == {1: "snap:7:1:2", 2: "snap:7:1:2", 3: "1", 4: "2"}
    assert sorted((round(r.from_t, 3), round(r.to_t, 3)) for r in places.split_segments(seg, s).collect()) == [(0.0, 0.25), (0.25, 0.75), (0.75, 1.0)]
    assert places.snap_to_network(p, seg.limit(0)).count() == 0


def test_choice_is_a_fold_in_seed_order(spark):
    c = spark.createDataFrame([(1, 0, False, 100.0, 9), (1, 1, False, 70.0, 5), (1, 2, False, 35.0, 7), (2, 0, True, 60.0, 3), (2, 1, True, 1.0, 3)], "request_id int, i int, within_tolerance boolean, error_m double, turn_count int").withColumns({"tiny_loop_count": F.lit(0), "distance_m": F.lit(5000.0)})
    assert {r.request_id: r.i for r in choice.best_of_seeds(c).collect()} == {1: 1, 2: 0}
    e = spark.createDataFrame([(1, 0, False, 0.0, 10.0, None), (1, 1, True, 1.0, 10.0, None), (2, 0, False, 0.0, None, None), (3, 0, True, 9.0, None, None)], "request_id int, i int, available boolean, gain_m double, min_ft double, max_ft double")
    assert {r.request_id: (r.i, r.note) for r in choice.elevation_preferred(e).collect()} == {1: (1, "unmatched"), 2: (0, "unavailable"), 3: (0, "none")}
    shown = spark.createDataFrame([(1, True, 10.0), (2, True, 10.0), (3, False, 900.0)], "request_id int, within_tolerance boolean, error_m double")
    tries = spark.createDataFrame([(1, 0, False, 0.0), (1, 1, True, 50.0), (2, 0, False, 0.0)], "request_id int, i int, within_tolerance boolean, error_m double")
    assert {r.request_id: r.i for r in choice.regenerated(shown, tries).collect()} == {1: 1, 2: None, 3: None}


def test_summary_without_target_and_exempt_reversal(spark):
    steps = tables.order_routes(spark, DATA).where("route_id < 5").withColumn("target_m", F.lit(0.0))
    assert routes.route_summary(steps).where("error_m <> 0").isEmpty()
    there_and_back = spark.createDataFrame([(1, 0, 1, 2, 9, True), (1, 1, 2, 1, 9, True), (2, 0, 1, 2, 9, False), (2, 1, 2, 1, 9, False)], "route_id int, step int, from_id int, to_id int, way_id int, exempt boolean")
    assert {r.route_id: r.clean for r in routes.no_reversal(there_and_back).collect()} == {1: True, 2: False}


def test_sink_by_region(spark, tmp_path):
    df = sinks.with_region(tables.grid_nodes(spark, DATA))
    sinks.write_table(df, str(tmp_path / "nodes"), ["region"])
    back = spark.read.parquet(str(tmp_path / "nodes"))
    assert back.count() == df.count() and back.where("region is null").isEmpty() and len(list((tmp_path / "nodes").glob("region=*"))) == df.select("region").distinct().count()
