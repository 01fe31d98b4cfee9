"""Queries of the route searches over the town, with SQL that searches anew: walks step by step, least-cost paths by keyed recursion,
returns bucket by bucket, and the loops that are made of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopmill.operators import backbone, graph, search
from loopmill.plans.sql import brg, hav
from loopmill.plans.town import LOW32, TOWN, product32, town_net, trails
from loopmill.sources import tables

#: Metres walked, wanted of a return, and wanted of a loop; the cost at which a search for a path gives up.
WALK_M, RETURN_M, LOOP_M, MOST_COST = 700.0, 650.0, 900.0, 1500.0


def starts(spark, d):
    k = F.col("s_suppkey")
    return tables.read(spark, d, "supplier").select(k.alias("request_id"), k.alias("at"), (k * 13).alias("seed"), F.expr(search.NO_KEYS).alias("used"))


def side(spark, d) -> int:
    return int(tables.read(spark, d, "part").count() ** 0.5 - 1e-9) + 1


def joined(path):
    return F.array_join(path, " ")


def town_walks(spark, d):
    """A random walk from each supplier: the same edges in the same order as the draws say."""
    w = starts(spark, d).select(F.col("request_id").alias("walker"), "at", F.lit(WALK_M).alias("target_m"), "seed", F.lit(0).alias("drawn"), "used")
    found = search.random_walks(w, town_net(spark, d))
    return found.select(F.col("walker").alias("request_id"), F.col("at").alias("ended_at"), F.size("path").alias("n_steps"), joined("path").alias("path"), F.round("distance", 2).alias("distance"))


def town_paths(spark, d):
    """The path of least cost from each supplier to a node two rows up and three columns on, if there is one up to MOST_COST."""
    s = starts(spark, d).select(F.col("request_id").alias("walker"), "at", (F.col("at") + 2 * side(spark, d) + 3).alias("goal"), "used", F.lit(MOST_COST).alias("most_cost"))
    found = search.shortest_paths(s, town_net(spark, d))
    return found.select(F.col("walker").alias("request_id"), joined("path").alias("path"), F.round("distance", 2).alias("distance"))


def town_returns(spark, d):
    """From each supplier's next row and column home, with a length near the one wanted."""
    s = starts(spark, d).select(F.col("request_id").alias("walker"), (F.col("at") + side(spark, d) + 1).alias("at"), F.col("at").alias("goal"), "used", F.lit(RETURN_M).alias("remaining_m"))
    found = search.returns(s, town_net(spark, d), tables.grid_nodes(spark, d))
    return found.select(F.col("walker").alias("request_id"), joined("path").alias("path"), F.round("distance", 2).alias("distance"))


def town_requests(spark, d):
    return starts(spark, d).withColumn("target_m", F.lit(LOOP_M))


def town_loops(spark, d):
    """Each supplier's precise loop from all sweeps: found or not, its edges, length and error."""
    asked = town_requests(spark, d)
    loops = graph.settled(search.precise_loops(asked, town_net(spark, d), tables.grid_nodes(spark, d)), "town-loops")
    return asked.select("request_id").join(loops, "request_id", "left").select("request_id", F.col("path").isNotNull().alias("found"), joined("path").alias("path"), F.round("distance", 2).alias("distance"), F.round("error_m", 2).alias("error_m"))


def town_waypoints(spark, d):
    """Each supplier's loop by way of the trails most worth it within 0.4 of the length: found or not, its edges, length and error."""
    net, places = town_net(spark, d), tables.grid_nodes(spark, d)
    own = graph.settled(trails(spark, d), "town-trails")
    members = graph.components(own)
    size = own.hint("merge").join(members, own["u"] == members["node_id"]).groupBy("cluster_id").agg(F.round(F.sum("distance"), 6).alias("trail_m"))
    reach = search.WAYPOINT_REACH * LOOP_M
    far = graph.network_distances(starts(spark, d).select("request_id", F.col("at").alias("node_id")), tables.town_edges(spark, d), reach).withColumn("metres", F.round("metres", 6))
    asked = town_requests(spark, d).withColumn("seed", F.col("seed") + search.WAYPOINT_SEED).withColumn("most_cost", F.lit(MOST_COST))
    targets = graph.settled(backbone.pick_target_cluster(asked.select("request_id", F.lit(reach).alias("reach")), size, members, far), "town-targets")
    loops = graph.settled(search.waypoint_loops(asked, net, places, targets), "town-waypoints")
    return asked.select("request_id").join(loops, "request_id", "left").select("request_id", F.col("path").isNotNull().alias("found"), joined("path").alias("path"), F.round("distance", 2).alias("distance"), F.round("error_m", 2).alias("error_m"))


QUERIES = {f.__name__: f for f in (town_walks, town_paths, town_returns, town_loops, town_waypoints)}

#: The town's directed edges with all that a step's cost needs, and the turn table: what the second edge costs after the first, if unused.
NET = f"""{TOWN},
busy_at as (select from_id as node, bool_or(is_busy) as busy from directed group by 1),
net as materialized (
  select d.way_id, from_id, to_id, d.way_id || ':' || from_id || '>' || to_id as key, d.way_id || ':' || to_id || '>' || from_id as reverse,
         2 * d.way_id + (from_id > to_id)::bigint as seq, distance, name, is_trail, is_busy, lat2, lon2, {brg('lat1', 'lon1', 'lat2', 'lon2')} as bearing,
         t.busy and not m.has_signal as crossing, distance * case when is_trail then 0.5 else 1 end * case when z.has_signal then 1.12 else 1 end as base
  from directed d join busy_at t on t.node = from_id join nodes m on m.node_id = from_id join nodes z on z.node_id = to_id),
angled as (
  select x.key as k1, y.key as k2, x.reverse = y.key as back, y.crossing and not x.is_busy and not y.is_busy as unsafe, x.name = y.name as same, y.base,
         case when x.way_id = y.way_id then 0 else least(abs(y.bearing - x.bearing), 360 - abs(y.bearing - x.bearing)) end as angle
  from net x join net y on x.to_id = y.from_id),
turns as materialized (
  select k1, k2, back, base * case when same and angle < 120 then 0.8 else 1 end * case when angle < 25 then 1 when angle < 45 then 1.15 when angle < 120 then 1.55 else 2.4 end as weight
  from angled where not unsafe)"""


def drawing(seeds: str, most: int) -> str:
    """CTE draws(seed, n, u) for the seeds of a table and n up to `most`."""
    return f"""
drawn0 as (select seed, n, (seed + n * 1831565813) {LOW32} as s from {seeds}, range(1, {most + 1}) r(n)),
drawn1 as (select seed, n, {product32('xor(s, s >> 15)', '(s | 1)')} as t from drawn0),
drawn2 as (select seed, n, t, (t + {product32('xor(t, t >> 7)', '(t | 61)')}) {LOW32} as m from drawn1),
draws as materialized (select seed, n, (xor(xor(t, m), xor(t, m) >> 14) {LOW32}) / 4294967296.0 as u from drawn2)"""


#: CTE walked(walker, here, path, distance) of walkers(walker, here, target, seed, drawn, used), by replaying every step.
WALK = """
walks as (
  select walker, here, target, seed, drawn, used, []::varchar[] as path, [{'n': here, 'm': 0::double}] as seen, 0::double as distance, null::varchar as last, 0 as step from walkers
  union all
  select walker, to_id, target, seed, drawn + 1, list_append(used, key), list_append(path, key), case when len(list_filter(seen, lambda v: v.n = to_id)) > 0 then seen else list_append(seen, {'n': to_id, 'm': distance + metres}) end,
         distance + metres, key, step + 1
  from (
    select *, row_number() over (partition by walker order by upto < u * total, case when upto < u * total then -seq else seq end) as place
    from (
      select *, sum(1 / cost) over (partition by walker order by seq) as upto, sum(1 / cost) over (partition by walker) as total
      from (
        select w.*, e.seq, e.key, e.to_id, e.distance as metres, d.u, coalesce(t.weight, e.base) * pow(2.3, len(list_filter(w.used, lambda k: k = e.key))) as cost
        from walks w join net e on e.from_id = w.here left join turns t on t.k1 = w.last and t.k2 = e.key join draws d on d.seed = w.seed and d.n = w.drawn + 1
        where w.distance < w.target and w.step < 500 and (w.last is null or t.k1 is not null) and not list_contains(w.used, e.reverse)
          and len(list_filter(w.used, lambda k: k = e.key)) < 2
          and len(list_filter(w.seen, lambda v: v.n = e.to_id and w.distance + e.distance - v.m < 160.9344)) = 0)))
  where place = 1),
walked as materialized (select walker, arg_max(here, step) as here, arg_max(path, step) as path, arg_max(used, step) as used, max(distance) as distance from walks group by walker)"""

#: CTE returned(walker, path, walked) of homeward(walker, here, goal, used, remaining): buckets in order, the cheapest label of a node and bucket goes on.
RETURN = f"""
homes as (
  select h.walker, h.here, h.goal, used, remaining, g.lat as glat, g.lon as glon, greatest(remaining + 220, 1.35 * {hav('x.lat', 'x.lon', 'g.lat', 'g.lon')}) as most,
         least(40, greatest(12, remaining / 260)) as width
  from homeward h join nodes x on x.node_id = h.here join nodes g on g.node_id = h.goal where remaining > 0),
labels as (
  select walker, here as node, 0::bigint as bucket, 0::double as cost, []::varchar[] as path, 0::double as walked, null::varchar as last, [{{'n': here, 'm': 0::double}}] as recent, here = goal as home from homes
  union all (
    with turn as (
      select *, bucket = min(bucket) over (partition by walker) as now, row_number() over (partition by walker, node, bucket order by round(cost, 6), path) as place from labels where not home)
    select walker, node, bucket, cost, path, walked, last, recent, home from turn where not now
    union all
    select walker, to_id, round(new_walked / width)::bigint, new_cost, list_append(path, key), new_walked, key, list_slice(list_prepend({{'n': to_id, 'm': new_walked}}, recent), 1, 8), to_id = goal
    from (
      select l.*, e.key, e.to_id, e.lat2, e.lon2, h.goal, h.glat, h.glon, h.most, h.width, l.walked + e.distance as new_walked,
             l.cost + coalesce(t.weight, e.base) * pow(2.3, len(list_filter(h.used, lambda k: k = e.key))) as new_cost
      from turn l join homes h on h.walker = l.walker join net e on e.from_id = l.node left join turns t on t.k1 = l.last and t.k2 = e.key
      where l.now and l.place = 1 and (l.last is null or (t.k1 is not null and not t.back)) and not list_contains(h.used, e.reverse)
        and len(list_filter(h.used, lambda k: k = e.key)) < 2 and len(list_filter(l.recent, lambda v: v.n = e.to_id and l.walked + e.distance - v.m < 160.9344)) = 0)
    where new_walked + 0.999 * {hav('lat2', 'lon2', 'glat', 'glon')} <= most)),
returned as materialized (
  select walker, path, walked from (select l.walker, l.path, l.walked, l.cost, abs(l.walked - h.remaining) as error from labels l join homes h on h.walker = l.walker where home)
  qualify row_number() over (partition by walker order by case when error <= 10 then 0 else round(error, 6) end, round(cost, 6), path) = 1)"""

#: CTE paths: of asked(walker, here, goal) the least-cost label of each edge; a path ends at its goal.
PATHS = f"""
paths using key (walker, key) as (
  select a.walker, e.key, e.base as cost, [e.key] as path, e.distance as walked, e.to_id, a.goal from asked a join net e on e.from_id = a.here
  union
  select n.walker, n.key, arg_min(n.cost, n.rank), arg_min(n.path, n.rank), arg_min(n.walked, n.rank), n.to_id, n.goal
  from (
    select l.walker, e.key, l.cost + t.weight as cost, list_append(l.path, e.key) as path, l.walked + e.distance as walked, e.to_id, l.goal,
           {{'c': round(l.cost + t.weight, 6), 'p': list_append(l.path, e.key)}} as rank
    from paths l join turns t on t.k1 = l.key and not t.back join net e on e.key = t.k2 where l.to_id <> l.goal and l.cost + t.weight <= {MOST_COST}) n
  left join (select walker, min(cost) as most from recurring.paths where to_id = goal group by walker) b on b.walker = n.walker
  left join recurring.paths o on o.walker = n.walker and o.key = n.key
  where n.cost <= coalesce(b.most, n.cost) and (o.cost is null or n.rank < {{'c': round(o.cost, 6), 'p': o.path}}) group by n.walker, n.key, n.to_id, n.goal)"""

#: The best of loops(request_id, i, walker, path, distance) that run no edge against an earlier one, for each supplier.
BEST = f"""steps as (select walker, unnest(path) as key, generate_subscripts(path, 1) as pos from loops),
reversed as (select distinct x.walker from steps x join net e on e.key = x.key join steps y on y.walker = x.walker and y.key = e.reverse and y.pos < x.pos),
best as (
  select request_id, path, distance, abs(distance - {LOOP_M}) as error_m from loops where walker not in (select walker from reversed)
  qualify row_number() over (partition by request_id order by abs(distance - {LOOP_M}) > 0.4 * 80.4672, case when abs(distance - {LOOP_M}) <= 0.4 * 80.4672 then 0 else round(abs(distance - {LOOP_M}), 6) end, i) = 1)
select s_suppkey as request_id, path is not null as found, array_to_string(path, ' ') as path, round(distance, 2) as distance, round(error_m, 2) as error_m
from supplier left join best on best.request_id = s_suppkey"""

ORACLE = {
    "town_walks": f"""
with recursive {NET},
walkers as (select s_suppkey as walker, s_suppkey as here, {WALK_M}::double as target, s_suppkey * 13 as seed, 0 as drawn, []::varchar[] as used from supplier), {drawing('walkers', 60)}, {WALK}
select walker as request_id, here as ended_at, len(path)::integer as n_steps, array_to_string(path, ' ') as path, round(distance, 2) as distance from walked""",
    "town_paths": f"""
with recursive {NET},
asked as (select s_suppkey as walker, s_suppkey as here, s_suppkey + 2 * w + 3 as goal from supplier, side), {PATHS}
select walker as request_id, array_to_string(arg_min(path, {{'c': round(cost, 6), 'p': path}}), ' ') as path, round(arg_min(walked, {{'c': round(cost, 6), 'p': path}}), 2) as distance
from paths where to_id = goal group by walker""",
    "town_returns": f"""
with recursive {NET},
homeward as (select s_suppkey as walker, s_suppkey + w + 1 as here, s_suppkey as goal, []::varchar[] as used, {RETURN_M}::double as remaining from supplier, side), {RETURN}
select walker as request_id, array_to_string(path, ' ') as path, round(walked, 2) as distance from returned""",
    "town_loops": f"""
with recursive {NET},
sweeps as (select s_suppkey as request_id, i, s_suppkey * 64 + i as walker, s_suppkey * 13 + i * 104729 as seed from supplier, range(0, 10) r(i)), {drawing('sweeps', 60)},
walkers as (
  select walker, request_id as here, {LOOP_M} * (0.32 + i / 9.0::double * 0.4 + (u - 0.5) * 0.05) as target, s.seed, 1 as drawn, []::varchar[] as used from sweeps s join draws d on d.seed = s.seed and d.n = 1), {WALK},
homeward as (select k.walker, k.here, s.request_id as goal, k.path as used, {LOOP_M} - k.distance as remaining from walked k join sweeps s using (walker) where len(k.path) > 0), {RETURN},
loops as (
  select s.request_id, s.i, s.walker, list_concat(k.path, r.path) as path, k.distance + r.walked as distance from returned r join walked k using (walker) join sweeps s using (walker)),
{BEST}""",
    "town_waypoints": f"""
with recursive {NET},
strolls as (
  select s_suppkey as request_id, s_suppkey as node_id, 0::double as metres from supplier
  union all select request_id, to_id, metres + distance from strolls join directed on from_id = node_id where metres + distance <= {0.4 * LOOP_M}),
far as (select request_id, node_id, round(min(metres), 6) as metres from strolls group by 1, 2),
size as (select cluster_id, round(sum(distance), 6) as trail_m from trails join cluster on node = u group by 1),
entry as (select request_id, cluster_id, node_id, metres from far join cluster on node = node_id qualify row_number() over (partition by request_id, cluster_id order by metres, node_id) = 1),
targets as materialized (
  select request_id, node_id from entry join size using (cluster_id) where trail_m > 0
  qualify row_number() over (partition by request_id order by trail_m / (1 + metres / 400) desc, cluster_id) = 1),
asked as (select request_id as walker, request_id as here, node_id as goal from targets where node_id <> request_id), {PATHS},
led as materialized (
  select walker as request_id, arg_min(path, {{'c': round(cost, 6), 'p': path}}) as before, arg_min(walked, {{'c': round(cost, 6), 'p': path}}) as out_m from paths where to_id = goal group by walker
  union all select request_id, [], 0 from targets where node_id = request_id),
sweeps as materialized (
  select request_id, i, request_id * 64 + i as walker, request_id * 13 + 999 + i * 50021 as seed, node_id, before, out_m from led join targets using (request_id), range(0, 3) r(i) where out_m < {LOOP_M}), {drawing('sweeps', 60)},
walkers as (
  select walker, node_id as here, ({LOOP_M} - out_m) * (0.25 + i / 2.0::double * 0.4 + (u - 0.5) * 0.05) as target, s.seed, 1 as drawn, before as used from sweeps s join draws d on d.seed = s.seed and d.n = 1), {WALK},
homeward as (select k.walker, k.here, s.request_id as goal, k.used, {LOOP_M} - s.out_m - k.distance as remaining from walked k join sweeps s using (walker) where len(k.path) > 0), {RETURN},
loops as (select s.request_id, s.i, s.walker, list_concat(k.used, r.path) as path, s.out_m + k.distance + r.walked as distance from returned r join walked k using (walker) join sweeps s using (walker)),
{BEST}""",
}
