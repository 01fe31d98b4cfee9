"""Queries of the town's trails, hulls and elements: targets, edge sets, starts' ways out, corners, payloads; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopmill.functions import geo, tags
from loopmill.operators import backbone, bridges, graph, requests
from loopmill.plans.sql import NODES, REFS, hav
from loopmill.plans.town import NEAR_M, ORACLE as TOWN_ORACLE, TOWN, trails
from loopmill.sources import tables

#: Files that the payload of elements is written to.
PAYLOADS = 8


def starts(spark, d):
    k = F.col("s_suppkey")
    return tables.read(spark, d, "supplier").select(k.alias("request_id"), k.alias("node_id"))


def town_targets(spark, d):
    """For each supplier's start the trails most worth the way, within NEAR_M along the streets."""
    own = graph.settled(trails(spark, d), "town-trails")
    members = graph.components(own)
    size = own.hint("merge").join(members, own["u"] == members["node_id"]).groupBy("cluster_id").agg(F.round(F.sum("distance"), 6).alias("trail_m"))
    far = graph.network_distances(starts(spark, d), tables.town_edges(spark, d), NEAR_M).withColumn("metres", F.round("metres", 6))
    best = backbone.pick_target_cluster(starts(spark, d).select("request_id", F.lit(NEAR_M).alias("reach")), size, members, far)
    return best.select("request_id", "cluster_id", "node_id", F.round("metres", 2).alias("metres"), F.round("score", 3).alias("score"))


def sets(spark, d):
    found = graph.settled(bridges.bridges(trails(spark, d)), "town-bridges")
    spurs, key = found.where("not worthwhile"), ["way_id", "u", "v"]
    exempt = found.where("worthwhile").select(*key).unionByName(bridges.start_connectors(starts(spark, d), spurs).select(*key))
    return bridges.edge_sets(tables.town_edges(spark, d).where("is_trail"), spurs, exempt)


def town_edge_sets(spark, d):
    """The directed trail edges with their flags: dead ends, exempt ones (worthwhile bridges, and the suppliers' ways out) and excluded ones."""
    return sets(spark, d).select("edge_key", "is_spur", "is_exempt", "is_excluded")


def town_edge_counts(spark, d):
    """The sizes of the trail edges' sets, and of the network."""
    return bridges.edge_counts(sets(spark, d))


def scattered(spark, d):
    """The grid's nodes, each moved a little, so that no three lie on a line."""
    k = F.col("node_id")
    moved = lambda c, n, m: (F.col(c) + (k * k * n + k * m) % 997 * 1e-7).alias(c)
    return tables.grid_nodes(spark, d).select("node_id", moved("lat", 31, 7), moved("lon", 17, 5))


def town_hulls(spark, d):
    """The corners of the hull around each supplier's start, at most ten, beginning with the one nearest the start."""
    nodes = scattered(spark, d)
    at = starts(spark, d).join(nodes, "node_id").withColumn("radius", backbone.hull_reach(F.lit(900.0)))
    return backbone.hulls_around(at, nodes).select("request_id", F.posexplode("nodes").alias("place", "node_id"))


def town_payload(spark, d):
    """Elements of all parts and orders, written as payloads and read again: nodes and their safe crossings, ways and their references."""
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    kind = F.when(p % 7 == 0, "traffic_signals").when(p % 11 == 0, "stop").when(p % 3 == 0, "crossing")
    crossing = F.when(p % 2 == 0, "traffic_signals").otherwise("zebra")
    of_node = F.map_filter(F.create_map(F.lit("highway"), kind, F.lit("crossing"), crossing), lambda _, v: v.isNotNull())
    # every tenth node comes twice, with another place later
    twice = F.explode(F.when(p % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    node = tables.read(spark, d, "part").select("p_partkey", twice.alias("again")).select(F.pmod(p, F.lit(PAYLOADS)).alias("g"), (2 * p + F.col("again")).alias("place"), F.lit("node").alias("type"), p.alias("id"), (39.0 + p * 1e-4 + F.col("again")).alias("lat"), (-75.0 + p * 1e-4).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), of_node.alias("tags"))
    way = tables.read(spark, d, "orders").select(F.pmod(o, F.lit(PAYLOADS)).alias("g"), (o + 10**9).alias("place"), F.lit("way").alias("type"), o.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(o % 50, o % 51, o % 50).alias("nodes"), F.create_map(F.lit("highway"), F.lit("path")).alias("tags"))
    each = node.unionByName(way).select("g", F.struct("place", F.to_json(F.struct("type", "id", "lat", "lon", "nodes", "tags")).alias("e")).alias("e"))
    elements = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["e"]), ",")
    payload = each.groupBy("g").agg(F.concat(F.lit('{"elements":['), elements, F.lit("]}")).alias("value"))
    nodes, ways = tables.read_osm(spark, tables.written_text(payload, "g"))
    n = nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.round("lat", 4).alias("lat"), "has_signal", F.lit(0).alias("n_refs"), F.lit(0).cast("long").alias("first_ref"))
    return n.unionByName(ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(False).alias("has_signal"), F.size("refs").alias("n_refs"), F.get("refs", F.lit(0)).alias("first_ref")))


def crossing_tags(spark, d):
    """The rule of safe crossings over all parts' tags."""
    p = F.col("p_partkey")
    value = lambda n, *words: F.element_at(F.array(*(F.lit(w) for w in words)), (p % n + 1).cast("int"))
    t = F.create_map(F.lit("highway"), value(5, "stop", "traffic_signals", "crossing", "", None), F.lit("crossing"), value(4, "traffic_signals", "zebra", None, ""))
    return tables.read(spark, d, "part").select("p_partkey", tags.has_safe_crossing(F.when(p % 13 > 0, t)).alias("safe"))


def region_elements(spark, d):
    """The runnable ways near the suppliers' places west of the grid, one network for all of them: kept ways, and all their nodes."""
    k, w, t = F.col("s_suppkey"), F.col("way_id"), F.col("tags")
    at = (39.95 + (k % 101) * 0.00053).alias("lat"), (-75.172 + (k % 7) * 0.001).alias("lon"), (900.5 + (k % 5) * 120.4).alias("radius")
    around = tables.read(spark, d, "supplier").select(k.alias("request_id"), *at)
    other = F.transform_values(t, lambda key, v: F.when((key == "highway") & (w % 17 == 0), "motorway").otherwise(v))
    area = F.when(w % 13 == 0, "yes").when(w % 13 == 1, "not yes").when(w % 13 == 2, "no")
    own = tables.order_ways(spark, d).withColumn("tags", F.map_concat(other, F.create_map(F.lit("area"), area)))
    ways, nodes = requests.region_network(around, own, tables.grid_nodes(spark, d))
    return ways.select(F.lit("way").alias("type"), w.alias("id"), F.size("refs").alias("n_refs")).unionByName(nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.lit(0).alias("n_refs")))


QUERIES = {f.__name__: f for f in (region_elements, town_targets, town_edge_sets, town_edge_counts, town_hulls, town_payload, crossing_tags)}

#: The CTEs of bridges and of their far sides, as in the SQL of bridge_links.
BRIDGES = TOWN_ORACLE["bridge_links"].split(f"{TOWN},", 1)[1].rsplit("\nselect", 1)[0]
SETS = f"""
with recursive {TOWN},{BRIDGES},
cut as (
  select a.way_id, u, v, f.start as child, case when f.start = u then v else u end as parent, coalesce(i.links >= s.n, false) as worthwhile
  from apart a join far f on f.way_id = a.way_id join size s on s.way_id = f.way_id and s.start = f.start left join inside i on i.way_id = s.way_id and i.start = s.start),
climb as (
  select s_suppkey as node, null::bigint as way_id from supplier
  union select c.parent, c.way_id from climb k join cut c on c.child = k.node where not c.worthwhile),
flags as (
  select way_id || ':' || from_id || '>' || to_id as edge_key, from_id, way_id in (select way_id from cut where not worthwhile) as is_spur,
         way_id in (select way_id from cut where worthwhile union all select way_id from climb where way_id is not null) as is_exempt
  from directed where is_trail)"""

ORACLE = {
    "region_elements": f"""
with {NODES}, {REFS},
asked as materialized (select 39.95 + (s_suppkey % 101) * 0.00053 as lat, -75.172 + (s_suppkey % 7) * 0.001 as lon, floor(901 + (s_suppkey % 5) * 120.4) as radius from supplier),
own as materialized (select way_id, refs from refs where way_id % 17 <> 0 and way_id % 13 not in (0, 1)),
steps as (select way_id, refs[i] as a, refs[least(i + 1, len(refs))] as b from (select way_id, refs, unnest(range(1, len(refs) + 1)) as i from own)),
lines as materialized (
  select way_id, x.lat as lat1, x.lon as lon1, y.lat as lat2, y.lon as lon2, cos(radians((x.lat + y.lat) / 2)) as k
  from steps join nodes x on x.node_id = a join nodes y on y.node_id = b),
pairs as (select *, (lon2 - lon1) * k as dx, lat2 - lat1 as dy from asked, lines),
feet as (select *, case when dx * dx + dy * dy = 0 then 0 else least(1, greatest(0, ((lon - lon1) * k * dx + (lat - lat1) * dy) / (dx * dx + dy * dy))) end as t from pairs),
kept as materialized (
  select distinct way_id from feet where round(least({hav('lat', 'lon', '(lat1 + t * (lat2 - lat1))', '(lon1 + t * (lon2 - lon1))')},
    {hav('lat', 'lon', 'lat1', 'lon1')}, {hav('lat', 'lon', 'lat2', 'lon2')}), 6) <= radius)
select 'way' as type, way_id as id, len(refs)::integer as n_refs from own semi join kept using (way_id)
union all select distinct 'node', unnest(refs), 0 from own semi join kept using (way_id)""",
    "town_targets": f"""
with recursive {TOWN},
walk as (
  select s_suppkey as request_id, s_suppkey as node_id, 0::double as metres from supplier
  union all select request_id, to_id, metres + distance from walk join directed on from_id = node_id where metres + distance <= {NEAR_M}),
far as (select request_id, node_id, round(min(metres), 6) as metres from walk group by 1, 2),
size as (select cluster_id, round(sum(distance), 6) as trail_m from trails join cluster on node = u group by 1),
entry as (
  select request_id, cluster_id, node_id, metres from far join cluster on node = node_id
  qualify row_number() over (partition by request_id, cluster_id order by metres, node_id) = 1)
select request_id, cluster_id, node_id, round(metres, 2) as metres, round(trail_m / (1 + metres / 400), 3) as score from entry join size using (cluster_id)
where trail_m > 0 qualify row_number() over (partition by request_id order by trail_m / (1 + metres / 400) desc, cluster_id) = 1""",
    "town_edge_sets": f"{SETS} select edge_key, is_spur, is_exempt, is_spur and not is_exempt as is_excluded from flags",
    "town_edge_counts": f"""{SETS}
select count(distinct from_id) as nodes, count(*) as directed, count_if(is_spur)::bigint as spur, count_if(is_exempt)::bigint as exempt, count_if(is_spur and not is_exempt)::bigint as excluded from flags""",
    # a corner's edge has all other points on its left; corners are followed from the least point on
    "town_hulls": f"""
with recursive {TOWN.split('grid as (', 1)[0].rstrip().rstrip(',')},
pts as (select node_id, lat + (node_id * node_id * 31 + node_id * 7) % 997 * 1e-7 as lat, lon + (node_id * node_id * 17 + node_id * 5) % 997 * 1e-7 as lon from nodes),
near as materialized (
  select s_suppkey as request_id, p.*, {hav('x.lat', 'x.lon', 'p.lat', 'p.lon')} as away from supplier join pts x on x.node_id = s_suppkey join pts p on {hav('x.lat', 'x.lon', 'p.lat', 'p.lon')} <= 500),
sides as materialized (
  select p.request_id, p.node_id as a, q.node_id as b from near p join near q on p.request_id = q.request_id and p.node_id <> q.node_id
  where not exists (select 1 from near r where r.request_id = p.request_id and r.node_id not in (p.node_id, q.node_id) and (q.lon - p.lon) * (r.lat - p.lat) - (q.lat - p.lat) * (r.lon - p.lon) < 0)),
round_trip as (
  select request_id, node_id as corner, 0 as seq, node_id as first from (select *, row_number() over (partition by request_id order by lon, lat) as k from near) where k = 1
  union all select t.request_id, s.b, seq + 1, first from round_trip t join sides s on s.request_id = t.request_id and s.a = t.corner where s.b <> first and seq < 200),
counted as (select *, count(*) over (partition by request_id) as n from round_trip),
taken as (
  select request_id, corner, seq, n, case when n > 10 then i else seq end as k, least(n, 10) as m from counted left join range(0, 10) r(i) on n > 10 and seq = i * n // 10 where n >= 3 and (n <= 10 or i is not null)),
nearest as (select t.request_id, k from taken t join near using (request_id) where node_id = corner qualify row_number() over (partition by t.request_id order by away, k) = 1)
select t.request_id, ((t.k - f.k + m) % m)::integer as place, corner as node_id from taken t join nearest f using (request_id)""",
    "town_payload": """
select 'node' as type, p_partkey as id, round(39.0 + p_partkey * 1e-4 + case when p_partkey % 10 = 0 then 1 else 0 end, 4) as lat,
       p_partkey % 7 = 0 or p_partkey % 11 = 0 or (p_partkey % 3 = 0 and p_partkey % 2 = 0) as has_signal, 0 as n_refs, 0::bigint as first_ref from part
union all select 'way', o_orderkey, null, false, 3, o_orderkey % 50 from orders""",
    "crossing_tags": """
select p_partkey, p_partkey % 13 > 0 and (p_partkey % 5 in (0, 1) or (p_partkey % 5 = 2 and p_partkey % 4 = 0)) as safe from part""",
}
