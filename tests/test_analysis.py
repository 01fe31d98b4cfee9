import math
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from loopmill.functions import tags, weights
from loopmill.operators import backbone, bridges, graph, requests
from loopmill.plans import registry
from loopmill.streaming import history

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["step_weights", "legal_steps", "valid_requests", "repeated_requests", "located_requests", "near_ways", "near_nodes", "region_elements", "session_history"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "events", "supplier"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE[name]).df()
    key = lambda d: sorted((tuple(None if v is None or v != v else round(float(v), 4) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    assert len(got) > 0 and key(got) == key(want)


def apart(links, gone):
    """Node -> label without one link."""
    label = {n: n for _, u, v in links for n in (u, v)}
    for _ in label:
        for i, (_, u, v) in enumerate(links):
            if i != gone:
                label[u] = label[v] = min(label[u], label[v])
    return label


def test_bridges_against_brute_force(spark):
    rng, links, want = random.Random(7), [], {}
    for part in range(12):  # several components of one table
        n = rng.randint(2, 9)
        links += [(len(links) + i, 100 * part + rng.randrange(n), 100 * part + rng.randrange(n)) for i in range(rng.randint(1, 11))]
    links = [x for x in links if x[1] != x[2]]
    for i, (w, u, v) in enumerate(links):
        label = apart(links, i)
        if label[u] != label[v]:
            root = min(n for n, x in apart(links, None).items() if x == apart(links, None)[u])
            far = u if label[u] != label[root] else v
            nodes = {n for n, x in label.items() if x == label[far]}
            inside = sum(1 for j, (_, a, b) in enumerate(links) if j != i and a in nodes and b in nodes)
            want[w] = inside >= len(nodes)  # more links than a tree has
    df = spark.createDataFrame([(*x, 1.0) for x in links], "way_id long, u long, v long, distance double")
    got = bridges.bridges(df).collect()
    assert {r.way_id: r.worthwhile for r in got} == want and len(got) == len(want)
    assert bridges.bridges(df.limit(0)).count() == 0


def test_edge_sets_and_connector(spark):
    # triangle 1 2 3 with a tail 3 4 5 and a tail 2 6
    pairs = [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 4), (5, 4, 5), (6, 2, 6)]
    df = spark.createDataFrame([(*x, 1.0) for x in pairs], "way_id long, u long, v long, distance double")
    found = bridges.bridges(df)
    spurs = found.where("not worthwhile")
    way_out = bridges.start_connectors(spark.createDataFrame([(1, 5), (2, 1)], "request_id long, node_id long"), spurs)
    assert sorted((r.request_id, r.way_id) for r in way_out.collect()) == [(1, 4), (1, 5)]
    edges = df.select("way_id", F.col("u").alias("from_id"), F.col("v").alias("to_id")).union(df.select("way_id", "v", "u"))
    c = bridges.edge_counts(bridges.edge_sets(edges, spurs, way_out)).first()
    assert (c.nodes, c.directed, c.spur, c.exempt, c.excluded) == (6, 12, 6, 4, 2)


def test_hull(spark):
    rows = [(1, 10 * y + x, float(y), float(x)) for y in range(6) for x in range(6)] + [(2, 1, 0.0, 0.0), (2, 2, 0.0, 1.0)]
    hull = backbone.convex_hull(spark.createDataFrame(rows, "request_id long, node_id long, lat double, lon double"))
    got = hull.orderBy("request_id", "seq").collect()
    assert [r.node_id for r in got if r.request_id == 1] == [0, 5, 55, 50] and sorted(r.node_id for r in got if r.request_id == 2) == [1, 2]
    starts = spark.createDataFrame([(1, 5.0, 5.1), (2, 0.0, 0.0)], "request_id long, lat double, lon double")
    assert [(r.request_id, r.nodes) for r in backbone.hull_nodes(hull, starts).collect()] == [(1, [55, 50, 0, 5])]


def test_target_cluster(spark):
    req = spark.createDataFrame([(1, 500.0), (2, 50.0)], "request_id long, reach double")
    clusters = spark.createDataFrame([(7, 1000.0), (8, 1500.0), (9, 0.0)], "cluster_id long, trail_m double")
    members = spark.createDataFrame([(7, 70), (7, 71), (8, 80), (9, 90)], "cluster_id long, node_id long")
    dist = spark.createDataFrame([(1, 70, 90.0), (1, 71, 100.0), (1, 80, 400.0), (1, 90, 1.0), (2, 70, 60.0)], "request_id long, node_id long, metres double")
    assert [(r.request_id, r.cluster_id, r.node_id) for r in backbone.pick_target_cluster(req, clusters, members, dist).collect()] == [(1, 7, 70)]


def test_region_network_against_all_pairs(spark):
    """Overlapping discs with cells wholly inside them, ways with missing, repeated and no nodes, against measuring every pair."""
    rng = random.Random(12)
    nodes = {i: (40 + rng.uniform(-0.08, 0.08), -75 + rng.uniform(-0.08, 0.08)) for i in range(600)}
    ways = []
    for i in range(400):
        at = rng.randrange(600)
        near = sorted(nodes, key=lambda n: math.dist(nodes[n], nodes[at]))[:12]
        ways.append((i, [rng.choice([*near, 5000]) for _ in range(rng.randrange(5))], {"highway": rng.choice(["path", "service", "trunk"])}))
    ways += [(900, [1, 5000, 2], {"highway": "path"}), (901, [5000], {"highway": "path"}), (902, None, {"highway": "path"}), (903, [3, 3], {"highway": "path", "area": "yes"})]
    asked = [(1, 40.0, -75.0, 3000.4), (2, 40.001, -75.002, 3000.4), (3, 40.03, -75.03, 400.0), (4, None, -75.0, 9000.0), (5, 40.0, -75.0, None)]
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    r, w = f(asked, "request_id long, lat double, lon double, radius double"), f(ways, "way_id long, refs array<long>, tags map<string,string>")
    n = f([(i, *p) for i, p in nodes.items()], "node_id long, lat double, lon double")
    found, used = requests.region_network(r, w.unionByName(w.limit(50)), n)

    def hav(a, b, c, e):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    def away(p, x, y):
        k = math.cos(math.radians((x[0] + y[0]) / 2))
        dx, dy = (y[1] - x[1]) * k, y[0] - x[0]
        t = 0 if dx == dy == 0 else min(1, max(0, ((p[1] - x[1]) * k * dx + (p[0] - x[0]) * dy) / (dx * dx + dy * dy)))
        return min(hav(*p, x[0] + t * dy, x[1] + t * (y[1] - x[1])), hav(*p, *x), hav(*p, *y))

    want = set()
    for i, refs, t in ways:
        lines = [(nodes[a], nodes.get(b, nodes[a])) for a, b in zip(refs or [], [*(refs or [])[1:], None], strict=False) if a in nodes]
        if t["highway"] != "trunk" and "area" not in t and any(away((la, lo), x, y) <= round(m) for _, la, lo, m in asked[:3] for x, y in lines):
            want.add(i)
    assert {x.way_id for x in found.collect()} == want and found.count() == len(want) and 20 < len(want) < 350
    of = {n for i, refs, _ in ways if i in want for n in refs if n in nodes}
    assert sorted(x.node_id for x in used.collect()) == sorted(of)
    assert requests.covered_cells(requests.discs(r)).count() > 4
    assert requests.region_network(r.limit(0), w, n)[0].count() == 0


def test_runnable_and_weights(spark):
    w = spark.createDataFrame([(1, {"highway": "path"}), (2, {"highway": "motorway"}), (3, {"highway": "pedestrian", "area": "yes"}), (4, None)], "way_id long, tags map<string,string>")
    assert [r.way_id for r in requests.runnable(w).collect()] == [1] and len(tags.RUNNABLE_HIGHWAYS) == 16
    no, yes = F.lit(False), F.lit(True)
    x = spark.range(1).select(weights.edge_weight(F.lit(100.0), yes, yes, yes, F.lit(1), yes, F.lit("sharp")).alias("a"), weights.is_legal(yes, yes, F.lit(9), F.lit(9)).alias("b"), weights.is_legal(no, no, F.lit(2), F.lit(0)).alias("c")).first()
    assert abs(x.a - 100 * 0.5 * 0.55 * 1.12 * 2.3 * 2.4) < 1e-9 and x.b and not x.c


def test_history_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=i), i, rng.choice("aab"), float(i)) for i in range(60) for k in [rng.randrange(3)]]
    schema = "key long, ts timestamp, seq long, request string, error_m double"
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = history.history_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    seen = {}

    def keep(df, batch):
        for r in df.collect():
            seen.setdefault(r.key, {}).setdefault(batch, []).append((r.place, r.seq))

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {k: sorted(v[max(v)]) for k, v in seen.items()}
    want = {}
    for r in history.history(spark.createDataFrame(rows, schema)).collect():
        want.setdefault(r.key, []).append((r.place, r.seq))
    assert last == {k: sorted(v) for k, v in want.items()}


def test_new_queries_run(spark):
    counts = Counter({n: registry.QUERIES[n](spark, DATA).count() for n in ("hull_corners", "bridge_links", "trail_edge_counts", "trail_targets")})
    assert counts["trail_edge_counts"] == 1 and counts["hull_corners"] > 0


def test_ways_are_counted_without_their_pairs(spark):
    from loopmill.functions import geo
    from loopmill.operators import requests as R

    # way 7 has several segments, way 900 a very long one; requests 3 and 5 ask for the same
    lines = [(i if i % 40 else 7, 39.95 + i % 20 * 1e-3, -75.16 + i // 20 * 1e-3, 39.95 + i % 20 * 1e-3 + 4e-4, -75.16 + i // 20 * 1e-3 + 9e-4) for i in range(400)] + [(900, 39.9, -75.2, 40.0, -75.1)]
    segments = spark.createDataFrame(lines, "way_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    asked = spark.createDataFrame([(1, 39.955, -75.155, 300.0), (2, 39.96, -75.15, 900.0), (3, 39.95, -75.16, 700.0), (5, 39.95, -75.16, 700.0), (8, None, -75.0, 700.0), (9, 10.0, 10.0, 500.0)], "request_id long, lat double, lon double, radius double")
    got = {r.request_id: (r.n_ways, r.ways) for r in R.ways_counted(asked, segments).collect()}
    foot = geo.project_to_segment(*(F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")))
    pairs = asked.crossJoin(segments).where(foot["dist"] <= F.col("radius")).select("request_id", "way_id").distinct().collect()
    want = {i: (len(w), sum(w)) for i in {p.request_id for p in pairs} for w in [[p.way_id for p in pairs if p.request_id == i]]}
    assert got == want and got[3] == got[5]


def test_requests_are_never_broadcast_with_their_cells(spark):
    from loopmill.operators import requests as R

    asked = spark.createDataFrame([(1, 39.955, -75.155, 8000.0)], "request_id long, lat double, lon double, radius double")
    nodes = spark.createDataFrame([(1, 39.955, -75.155)], "node_id long, lat double, lon double")
    near = R.nodes_around(asked, nodes)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 1


def test_hulls_meet_in_few_groups_and_are_shared(spark):
    """One group a request (the parts' hulls need none), the least id of one place, one hull for requests of one place."""
    nodes = spark.createDataFrame([(i, 39.95 + i % 7 * 1e-4, -75.16 + i // 7 % 7 * 1e-4) for i in range(98)], "node_id long, lat double, lon double")
    hull = backbone.convex_hull(nodes.select(F.lit(1).cast("long").alias("request_id"), "node_id", "lat", "lon"))
    assert hull._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInPandas") == 1
    asked = spark.createDataFrame([(4, 39.95, -75.16, 500.0), (6, 39.95, -75.16, 500.0)], "request_id long, lat double, lon double, radius double")
    assert sorted((r.request_id, r.nodes) for r in backbone.hulls_around(asked, nodes).collect()) == [(i, [0, 42, 48, 6]) for i in (4, 6)]


def test_points_of_one_place_look_once(spark):
    from loopmill.operators import places, spatial

    points = spark.createDataFrame([(i, 39.95 + i % 3 * 1e-3, -75.16) for i in range(60)] + [(99, None, 1.0)], "point_id long, lat double, lon double")
    spot, who = spatial.spots(points)
    assert spot.count() == 3 and who.count() == 60
    nodes = spark.createDataFrame([(1, 39.95, -75.16), (2, 39.952, -75.16)], "node_id long, lat double, lon double")
    assert sorted((r.point_id, r.node_id) for r in spatial.nearest_node(points, nodes).collect()) == [(i, 2 if i % 3 == 2 else 1) for i in range(60)]
    line = spark.createDataFrame([(7, 1, 2, 39.95, -75.16, 39.952, -75.16)], "way_id long, a long, b long, lat1 double, lon1 double, lat2 double, lon2 double")
    got = places.snap_to_network(points, line).collect()
    assert sorted((r.point_id, r.way_id, round(r.t, 3)) for r in got) == [(i, 7, round(i % 3 / 2, 3)) for i in range(60)]


def test_components_and_bridges_take_few_jobs_and_no_broadcast(spark):
    # a chain whose labels would creep along it, and a ladder with a tail, searched whole and by levels
    chain = [(i, 1000 - (i * 37) % 200, 1000 - ((i + 1) * 37) % 200) for i in range(199)]
    ladder = [(500 + i, 2000 + i, 2001 + i) for i in range(6)] + [(600 + i, 2000 + i, 2006 - i) for i in range(3)] + [(700, 2006, 2007), (701, 2006, 2007), (702, 2007, 2010)]
    df = spark.createDataFrame(chain + ladder, "way_id long, u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    assert {r.cluster_id for r in graph.components(df).collect()} == {801, 2000}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setJobGroup("rest", "")
    assert len(jobs) < 120
    small = sorted(map(tuple, bridges.bridges(df.where("way_id >= 500")).collect()))
    assert small == sorted(map(tuple, bridges.bridges(df.where("way_id >= 500"), 0).collect())) == [(702, 2007, 2010, 2010, 2007, False)]
    assert "Broadcast" not in bridges.bridges(df)._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_discs_only_in_the_cells_they_run_through(spark):
    line = spark.createDataFrame([(1, 40.001, -75.001, 40.201, -74.801), (2, 40.0, -75.0, 40.1, -75.0), (3, 40.005, -74.9, 40.005, -74.95), (4, 41.0, -75.0, 41.1, -75.0)], "way_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = {(r.way_id, r.cy, r.cx) for r in requests.crossed(line, 4000, 4030, -7501, -7480).select("way_id", "cy", "cx").collect()}
    points = {(w, math.floor((a + t / 997 * (c - a)) / requests.CELL), math.floor((b + t / 997 * (d - b)) / requests.CELL)) for w, a, b, c, d in map(tuple, line.collect()) if w < 4 for t in range(998)}
    assert points <= rows and len([r for r in rows if r[0] == 1]) < 64 and not [r for r in rows if r[0] == 4]
    same = spark.createDataFrame([(i, 40.0, -75.0, 100.0 + i % 3) for i in range(30)], "request_id long, lat double, lon double, radius double")
    assert [r.radius for r in requests.widest(same).collect()] == [102.0]
