"""Pieces of SQL that several queries share."""

from __future__ import annotations


def hav(a, b, c, e):
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def brg(a, b, c, e):
    raw = f"(degrees(atan2(sin(radians({e} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({e} - {b})))) + 360)"
    return f"({raw} - 360 * floor({raw} / 360))"


NODES = "side as (select ceil(sqrt(count(*)))::bigint as w from part), nodes as (select p_partkey as node_id, 39.95 + 0.0012 * (p_partkey // w) as lat, -75.16 + 0.0012 * (p_partkey % w) as lon, p_partkey % w > 0 and p_partkey // w > 0 and (p_partkey % w + p_partkey // w) % 5 = 0 as has_signal from part, side)"
REFS = "refs as (select l_orderkey as way_id, list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as refs, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as supp from lineitem group by 1)"
STEPS = f"""with {NODES}, {REFS}, raw as (select way_id as route_id, refs, supp, unnest(range(1, len(refs) + 1)) as i from refs),
steps as (select route_id, i - 1 as step, refs[i] as from_id, refs[case when i = len(refs) then 1 else i + 1 end] as to_id, supp[i] % 5 as way_id, 'Street ' || (supp[i] % 5) as name, supp[i] % 5 = 0 as is_trail from raw),
placed as (select s.*, x.lat as lat1, x.lon as lon1, y.lat as lat2, y.lon as lon2, y.has_signal as to_signal, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} as distance, {brg('x.lat', 'x.lon', 'y.lat', 'y.lon')} as bearing from steps s join nodes x on x.node_id = from_id join nodes y on y.node_id = to_id),
lagged as (select *, lag(bearing) over w as before, lag(way_id) over w as way_before, sum(distance) over w as so_far from placed window w as (partition by route_id order by step rows unbounded preceding)),
angled as (select *, case when way_before is null or way_before = way_id then 0 else least(abs(bearing - before), 360 - abs(bearing - before)) end as angle from lagged),
measured as (select *, case when angle < 25 then 'straight' when angle < 45 then 'slight' when angle < 120 then 'turn' else 'sharp' end as turn from angled)"""
