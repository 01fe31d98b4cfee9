"""Queries over a town's streets (turns, splits, clusters) and over routes' points, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopmill.functions import draws
from loopmill.operators import bridges, choice, folds, graph, places, routes, search
from loopmill.plans.sql import NODES, STEPS, brg, hav
from loopmill.sources import tables

#: Metres that distances reach.
NEAR_M = 420.0


def trails(spark, d):
    return graph.undirected(tables.town_edges(spark, d).where("is_trail"))


def town_net(spark, d):
    return graph.settled(search.prepared(tables.town_edges(spark, d), tables.grid_nodes(spark, d)), "town")


def town_turns(spark, d):
    """The turn table of the town, counted by kind."""
    t = search.transitions(search.prepared(tables.town_edges(spark, d), tables.grid_nodes(spark, d)))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("u_turn").alias("u_turns"), F.count_if("unsafe").alias("unsafe"), F.round(F.sum("angle"), 1).alias("angles"), F.round(F.sum("weight"), 1).alias("weights"))


def town_split(spark, d):
    """Directed edges of the town after every customer's place is put on it."""
    edges = tables.town_edges(spark, d)
    s = tables.grid_streets(spark, d).join(edges.select("way_id").distinct(), "way_id", "left_semi")
    k = F.col("c_custkey")
    at = tables.read(spark, d, "customer").select(k.alias("point_id"), (39.95 + (k % 101) * 0.00053).alias("lat"), (-75.16 + (k % 89) * 0.00061).alias("lon"))
    snaps = graph.settled(places.snap_to_network(at, s).withColumn("t", F.round("t", 6)), "town-snaps")
    both, _ = places.split_edges(edges, s, snaps)
    return both.select("edge_key", "reverse_key", "name", "is_trail", "is_busy", F.round("distance", 2).alias("distance"))


def trail_clusters(spark, d):
    own = trails(spark, d)
    found = graph.components(own)
    metres = own.hint("merge").join(found, own["u"] == found["node_id"]).groupBy("cluster_id").agg(F.round(F.sum("distance"), 1).alias("trail_m"))
    return metres.hint("merge").join(found.groupBy("cluster_id").agg(F.count("*").alias("n_nodes")), "cluster_id")


def dead_ends(spark, d):
    return graph.dead_end_spurs(trails(spark, d)).select("way_id", "u", "v")


def bridge_links(spark, d):
    return bridges.bridges(trails(spark, d)).select("way_id", "u", "v", "worthwhile")


def start_distances(spark, d):
    starts = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("node_id"))
    return graph.network_distances(starts, tables.town_edges(spark, d), NEAR_M).withColumn("metres", F.round("metres", 2))


def route_choice(spark, d):
    """The rule that picks among a precise loop, one by the trails, laps and the base; a customer's first four orders stand for them."""
    c = tables.order_candidates(spark, d).where("i < 4").withColumn("place", F.col("i").cast("int"))
    combined = F.col("error_m") / 1609.344 + 0.004 * F.col("turn_count") + 1.2 * F.col("tiny_loop_count")
    c = c.select("request_id", "place", "error_m", "distance_m", "turn_count", F.round(combined, 9).alias("combined_score"))
    return search.chosen(c).select("request_id", "place", "within_tolerance")


def route_arrows(spark, d):
    a = folds.direction_arrows(tables.order_routes(spark, d))
    return a.select("route_id", F.col("step").cast("int").alias("step"), "is_trail", F.col("pass").cast("int").alias("pass"), *(F.round(c, 5).alias(c) for c in ("lat", "lon", "bearing")))


def route_points_kept(spark, d):
    return folds.decimated_points(tables.order_routes(spark, d)).select("route_id", "step", *(F.round(c, 5).alias(c) for c in ("lat", "lon")))


def route_track(spark, d):
    return routes.route_points(tables.order_routes(spark, d)).select("route_id", "idx", *(F.round(c, n).alias(c) for c, n in (("lat", 5), ("lon", 5), ("at_m", 2))))


def route_thumbnails(spark, d):
    return routes.fitted_points(tables.order_routes(spark, d)).select("route_id", "idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def seeded_draws(spark, d):
    u = draws.uniform(F.col("o_orderkey"), F.lit(1).cast("long"))
    return tables.read(spark, d, "orders").select("o_orderkey", F.round(u, 9).alias("u"))


QUERIES = {f.__name__: f for f in (town_turns, town_split, trail_clusters, dead_ends, bridge_links, start_distances, route_choice, route_arrows, route_points_kept, route_track, route_thumbnails, seeded_draws)}

TOWN = f"""
{NODES},
grid as (
  select 2 * p_partkey as way_id, p_partkey as a, p_partkey + 1 as b from part, side where p_partkey % w < w - 1
  union all select 2 * p_partkey + 1, p_partkey, p_partkey + w from part, side),
town as (
  select way_id, a, b, x.lat as lat1, x.lon as lon1, y.lat as lat2, y.lon as lon2, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} as distance,
         case when way_id % 2 = 0 then 'Row ' || (a // w) else 'Col ' || (a % w) end as name,
         (way_id * way_id * 17 + way_id * 5) % 997 < 560 as is_trail, way_id % 2 = 0 and (a // w) % 6 = 5 as is_busy
  from grid join nodes x on x.node_id = a join nodes y on y.node_id = b, side
  where (way_id * way_id * 31 + way_id * 7) % 1009 < 706),
directed as (
  select *, a as from_id, b as to_id from town union all
  select way_id, b, a, lat2, lon2, lat1, lon1, distance, name, is_trail, is_busy, b, a from town),
trails as (select way_id, a as u, b as v, distance from town where is_trail),
linked as (select way_id, u, v from trails union all select way_id, v, u from trails),
reach as (select distinct u as node, u as root from linked union select b.v, r.root from reach r join linked b on b.u = r.node),
cluster as (select node, min(root) as cluster_id from reach group by node)
"""
#: A folded counter along a route, step by step: add the length, and start anew at each mark.
FOLD = """
numbered as (select *, row_number() over (partition by route_id order by step) as i, count(*) over (partition by route_id) as n_steps,
                    row_number() over (partition by route_id, way_id, least(from_id, to_id), greatest(from_id, to_id) order by step) as pass from measured),
fold as (
  select route_id, 0::bigint as i, {start}::double as n, false as hit from (select distinct route_id from numbered)
  union all
  select f.route_id, s.i, case when {hit} then 0 else f.n + s.distance end, {hit} from fold f join numbered s on s.route_id = f.route_id and s.i = f.i + 1)
"""
SIDE = "radians(bearing + 90)"
DELTA = "((pass - 1) * 3.5 / 6371000.0)"
TO_LAT = f"asin(sin(radians(mlat)) * cos({DELTA}) + cos(radians(mlat)) * sin({DELTA}) * cos({SIDE}))"
TO_LON = f"mlon + degrees(atan2(sin({SIDE}) * sin({DELTA}) * cos(radians(mlat)), cos({DELTA}) - sin(radians(mlat)) * sin({TO_LAT})))"
LOW32 = "& 4294967295"


def product32(a: str, b: str) -> str:
    return f"((((((({a}) >> 16) * ({b})) & 65535) << 16) + (({a}) & 65535) * ({b})) {LOW32})"


ORACLE = {
    "town_turns": f"""
with recursive {TOWN},
bearings as (select *, way_id || ':' || from_id || '>' || to_id as key, way_id || ':' || to_id || '>' || from_id as reverse, {brg('lat1', 'lon1', 'lat2', 'lon2')} as bearing from directed),
busy_at as (select from_id as node, bool_or(is_busy) as busy from directed group by 1),
pairs as (
  select y.*, x.key as k1, x.reverse as r1, x.name as n1, x.is_busy as b1, m.has_signal as from_signal, z.has_signal as to_signal, t.busy as from_busy,
         case when x.way_id = y.way_id then 0 else least(abs(y.bearing - x.bearing), 360 - abs(y.bearing - x.bearing)) end as angle
  from bearings x join bearings y on x.to_id = y.from_id join nodes m on m.node_id = y.from_id join nodes z on z.node_id = y.to_id join busy_at t on t.node = y.from_id),
kinds as (select *, case when angle < 25 then 'straight' when angle < 45 then 'slight' when angle < 120 then 'turn' else 'sharp' end as kind from pairs)
select kind, count(*) as n, count_if(r1 = key)::bigint as u_turns, count_if(from_busy and not from_signal and not b1 and not is_busy)::bigint as unsafe, round(sum(angle), 1) as angles,
       round(sum(distance * case when is_trail then 0.5 else 1 end * case when to_signal then 1.12 else 1 end * case when n1 = name and kind <> 'sharp' then 0.8 else 1 end
                 * case kind when 'slight' then 1.15 when 'turn' then 1.55 when 'sharp' then 2.4 else 1 end), 1) as weights
from kinds group by kind""",
    "town_split": f"""
with recursive {TOWN},
pts as (select c_custkey as point_id, 39.95 + (c_custkey % 101) * 0.00053 as lat, -75.16 + (c_custkey % 89) * 0.00061 as lon from customer),
sq as (select point_id, lat, lon, t.*, (lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) as dx, lat2 - lat1 as dy, cos(radians((lat1 + lat2) / 2)) as k from pts, town t),
ft as (select *, case when dx * dx + dy * dy = 0 then 0 else least(1, greatest(0, ((lon - lon1) * k * dx + (lat - lat1) * dy) / (dx * dx + dy * dy))) end as t from sq),
ms as (select *, round({hav('lat', 'lon', '(lat1 + t * (lat2 - lat1))', '(lon1 + t * (lon2 - lon1))')}, 4) as m from ft),
snaps as (select way_id, round(t, 6) as t from ms qualify row_number() over (partition by point_id order by m, way_id, a, b) = 1),
cuts as (select way_id, 0::double as t from town union select way_id, 1 from town union select way_id, t from snaps where t > 0.015 and t < 0.985),
pieces as (select way_id, t as from_t, lead(t) over (partition by way_id order by t) as to_t from cuts),
named as (
  select p.*, t.*, case when from_t <= 0 then a::varchar else 'snap:' || p.way_id || ':' || a || ':' || b || ':' || format('{{:.6f}}', from_t) end as m,
         case when to_t >= 1 then b::varchar else 'snap:' || p.way_id || ':' || a || ':' || b || ':' || format('{{:.6f}}', to_t) end as n,
         {hav('(lat1 + from_t * (lat2 - lat1))', '(lon1 + from_t * (lon2 - lon1))', '(lat1 + to_t * (lat2 - lat1))', '(lon1 + to_t * (lon2 - lon1))')} as metres
  from pieces p join town t on t.way_id = p.way_id where to_t is not null),
halves as (select *, m as f, n as g from named union all select *, n, m from named)
select way_id || ':' || f || '>' || g as edge_key, way_id || ':' || g || '>' || f as reverse_key, name, is_trail, is_busy, round(metres, 2) as distance from halves""",
    "trail_clusters": f"""
with recursive {TOWN}
select cluster_id, n_nodes, trail_m from (select cluster_id, count(*) as n_nodes from cluster group by 1)
join (select cluster_id, round(sum(distance), 1) as trail_m from trails join cluster on node = u group by 1) using (cluster_id)""",
    "dead_ends": f"""
with recursive {TOWN},
peel as (
  select 0 as round, way_id, u, v, true as more from trails
  union all
  select round + 1, way_id, u, v, bool_or(gone) over () from (
    select round, way_id, u, v, min(deg) = 1 as gone from (
      select *, count(*) over (partition by n) as deg from (select round, way_id, u, v, unnest([u, v]) as n from peel where more))
    group by all)
  qualify not gone),
core as (select way_id from peel where round = (select max(round) from peel) and not more)
select way_id, u, v from trails where way_id not in (select way_id from core)""",
    "bridge_links": f"""
with recursive {TOWN},
side_of as (
  select way_id as e, u as start, u as node from trails union select way_id, v, v from trails
  union select s.e, s.start, b.v from side_of s join linked b on b.u = s.node and b.way_id <> s.e),
apart as (select way_id, u, v, distance from trails t where not exists (select 1 from side_of s where s.e = t.way_id and s.start = t.u and s.node = t.v)),
far as (
  select a.way_id, s.start from apart a join side_of s on s.e = a.way_id join cluster c on c.node = a.u
  group by a.way_id, s.start, c.cluster_id having not bool_or(s.node = c.cluster_id)),
size as (select f.way_id, f.start, count(*) as n from far f join side_of s on s.e = f.way_id and s.start = f.start group by 1, 2),
inside as (
  select f.way_id, f.start, count(*) as links from far f join side_of s on s.e = f.way_id and s.start = f.start
  join trails t on t.u = s.node and t.way_id <> f.way_id group by 1, 2)
select a.way_id, u, v, coalesce(i.links >= s.n, false) as worthwhile from apart a join size s using (way_id) left join inside i on i.way_id = s.way_id and i.start = s.start""",
    "start_distances": f"""
with recursive {TOWN},
walk as (
  select s_suppkey as request_id, s_suppkey as node_id, 0::double as metres from supplier
  union all select request_id, to_id, metres + distance from walk join directed on from_id = node_id where metres + distance <= {NEAR_M})
select request_id, node_id, round(min(metres), 2) as metres from walk group by 1, 2""",
    "route_choice": """
with c as (
  select o_custkey as request_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, ((o_orderkey * 37) % 400)::double as error_m, (o_orderkey * 13) % 80 as turns,
         (4000 + o_orderkey % 1000)::double as distance_m, case when o_orderkey % 7 = 0 then 1 else 0 end as tiny from orders),
s as materialized (select *, round(error_m / 1609.344 + 0.004 * turns + 1.2 * tiny, 9) as score from c where place < 4),
r as (
  select request_id, first(place order by score, place) as lowest, min(error_m) filter (where place = 0) as pe, min(turns / greatest(distance_m / 1609.344, 0.1)) filter (where place = 0) as pt,
         min(score) filter (where place = 0) as ps, min(error_m) filter (where place = 1) as we, min(score) filter (where place = 1) as ws from s group by 1),
picked as materialized (
  select request_id, case when pe <= 80.4672 and coalesce(we <= 120.7008 and ws < ps, false) then 1 when pe <= 80.4672 and pt <= 14 then 0 else lowest end::integer as place from r)
select p.request_id, p.place, error_m <= 80.4672 as within_tolerance from picked p join s on s.request_id = p.request_id and s.place = p.place""",
    "route_arrows": STEPS.replace("with ", "with recursive ", 1) + "," + FOLD.format(start=110, hit="(f.n + s.distance >= 220 and s.distance > 5)") + f""",
marks as (select s.*, (lat1 + lat2) / 2 as mlat, (lon1 + lon2) / 2 as mlon from numbered s join fold f on f.route_id = s.route_id and f.i = s.i where f.hit)
select route_id, step::integer as step, is_trail, pass::integer as pass, round(case when pass > 1 then degrees({TO_LAT}) else mlat end, 5) as lat,
       round(case when pass > 1 then {TO_LON} else mlon end, 5) as lon, round(bearing, 5) as bearing from marks""",
    "route_points_kept": STEPS.replace("with ", "with recursive ", 1) + "," + FOLD.format(start="1e18", hit="(f.n + s.distance >= 25 or s.i = s.n_steps)") + """
select s.route_id, step::integer as step, round(lat2, 5) as lat, round(lon2, 5) as lon from numbered s join fold f on f.route_id = s.route_id and f.i = s.i where f.hit
union all select route_id, -1, round(lat1, 5), round(lon1, 5) from numbered where i = 1""",
    "route_track": f"""{STEPS}
select route_id, (step + 1)::integer as idx, round(lat2, 5) as lat, round(lon2, 5) as lon, round(so_far, 2) as at_m from measured
union all select route_id, 0, round(lat1, 5), round(lon1, 5), 0 from measured where step = 0""",
    "route_thumbnails": f"""{STEPS},
pts as (select route_id, (step + 1)::integer as idx, lat2 as lat, lon2 as lon from measured union all select route_id, 0, lat1, lon1 from measured where step = 0),
box as (select route_id, min(lat) as y0, min(lon) as x0, greatest(max(lat) - min(lat), 1e-6) as dy, greatest(max(lon) - min(lon), 1e-6) as dx from pts group by 1),
fit as (select *, least(46 / dx, 46 / dy) as k from box)
select route_id, idx, round((56 - dx * k) / 2 + (lon - x0) * k, 5) as x, round(56 - ((56 - dy * k) / 2 + (lat - y0) * k), 5) as y from pts join fit using (route_id)""",
    "seeded_draws": f"""
with s as (select o_orderkey, (o_orderkey + 1831565813) {LOW32} as s from orders),
t as (select o_orderkey, {product32('xor(s, s >> 15)', '(s | 1)')} as t from s),
m as (select o_orderkey, t, (t + {product32('xor(t, t >> 7)', '(t | 61)')}) {LOW32} as m from t),
x as (select o_orderkey, xor(t, m) as x from m)
select o_orderkey, round((xor(x, x >> 14) {LOW32}) / 4294967296.0, 9) as u from x""",
}
