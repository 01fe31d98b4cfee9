"""Where a long loop could go: the hull around each start, and the trails worth a detour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.functions import geo
from loopmill.operators.requests import nodes_around, places_asked

# Hull nodes kept, least and relative reach, metres at which a trail counts half.
HULL_NODES, LEAST_REACH_M, REACH_SHARE, HALF_M = 10, 500.0, 0.5, 400.0


def turns_left(o: tuple, a: tuple, b: tuple) -> bool:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]) > 0


def outline(points: list[tuple]) -> list[tuple]:
    """Hull of (x, y, id), counter-clockwise from the least point, without points inside an edge; of several in one place the least id counts; under three: as they are."""
    points = sorted(points)
    points = [p for i, p in enumerate(points) if i == 0 or p[:2] != points[i - 1][:2]]
    if len(points) < 3:
        return points
    halves = []
    for order in (points, points[::-1]):
        half: list[tuple] = []
        for p in order:
            while len(half) > 1 and not turns_left(half[-2], half[-1], p):
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def hull_of(group: pd.DataFrame) -> pd.DataFrame:
    corners = outline(list(zip(group["lon"], group["lat"], group["node_id"])))
    out = pd.DataFrame(corners, columns=["lon", "lat", "node_id"])
    out["request_id"], out["seq"] = group["request_id"].iloc[0], range(len(out))
    return out[["request_id", "seq", "node_id", "lat", "lon"]]


def partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corners of each request's nodes in a batch."""
    for pdf in batches:
        pdf = pdf.sort_values("request_id", kind="stable", ignore_index=True)
        who = pdf["request_id"].to_numpy()
        points = list(zip(pdf["lon"].tolist(), pdf["lat"].tolist(), pdf["node_id"].tolist()))
        cuts = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)] if len(who) else []
        rows = [(int(who[a]), n, y, x) for a, b in zip(cuts, cuts[1:]) for x, y, n in outline(points[a:b])]
        yield pd.DataFrame(rows, columns=["request_id", "node_id", "lat", "lon"]).astype({"request_id": "int64", "node_id": "int64", "lat": "float64", "lon": "float64"})


def convex_hull(nodes: DataFrame) -> DataFrame:
    """(request_id, seq, node_id, lat, lon) of nodes(request_id, node_id, lat, lon); of several in one place the least id counts.

    The nodes of a batch are cut to their corners, once where they are met and once where requests come together; only those meet in one group a request.
    """
    own = nodes.select(F.col("request_id").cast("long").alias("request_id"), F.col("node_id").cast("long").alias("node_id"), "lat", "lon")
    corners = "request_id long, node_id long, lat double, lon double"
    near = own.mapInPandas(partial_hulls, corners).repartition("request_id").sortWithinPartitions("request_id").mapInPandas(partial_hulls, corners)
    return near.groupBy("request_id").applyInPandas(hull_of, "request_id long, seq long, node_id long, lat double, lon double")


def hulls_around(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, nodes) as of hull_nodes, of the nodes within `radius` metres of requests(request_id, lat, lon, radius); one hull for all requests of one place and radius."""
    asked, who = places_asked(requests)
    hulls = hull_nodes(convex_hull(nodes_around(asked, nodes)), asked)
    return who.hint("merge").join(hulls.withColumnRenamed("request_id", "place_id"), "place_id").select("request_id", "nodes")


def hull_nodes(hull: DataFrame, starts: DataFrame) -> DataFrame:
    """(request_id, nodes): at most ten corners, evenly taken, turned so that the one nearest the start is first.

    starts(request_id, lat, lon). A hull of fewer than three corners gives no row.
    """
    h = hull.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id", "lat", "lon"))).alias("h")).where(F.size("h") >= 3)
    even = F.transform(F.sequence(F.lit(0), F.lit(HULL_NODES - 1)), lambda i: F.get("h", F.floor(i * F.size("h") / HULL_NODES).cast("int")))
    h = h.withColumn("h", F.when(F.size("h") > HULL_NODES, even).otherwise(F.col("h"))).join(starts.select("request_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "request_id")
    away = F.transform("h", lambda x, i: F.struct(geo.haversine(F.col("_lat"), F.col("_lon"), x["lat"], x["lon"]).alias("m"), i.alias("i")))
    first = F.array_min(away)["i"]
    ids = F.transform("h", lambda x: x["node_id"])
    return h.withColumns({"_ids": ids, "_k": first}).select("request_id", F.concat(F.slice("_ids", F.col("_k") + 1, F.size("_ids")), F.slice("_ids", F.lit(1), F.col("_k"))).alias("nodes"))


def hull_reach(target_m: Column) -> Column:
    return F.greatest(F.lit(LEAST_REACH_M), REACH_SHARE * target_m)


def pick_target_cluster(requests: DataFrame, clusters: DataFrame, members: DataFrame, distances: DataFrame) -> DataFrame:
    """(request_id, cluster_id, node_id, metres, score): the trails with most metres for the way there.

    requests(request_id, reach), clusters(cluster_id, trail_m), members(cluster_id, node_id), distances(request_id, node_id,
    metres) along the network. Each cluster is entered at its nearest node; ties go to the smaller node and cluster.
    """
    near = distances.hint("merge").join(members, "node_id").groupBy("request_id", "cluster_id").agg(F.min(F.struct("metres", "node_id")).alias("a"))
    scored = near.hint("merge").join(requests.select("request_id", "reach"), "request_id").where("a.metres <= reach").hint("merge").join(clusters.where("trail_m > 0"), "cluster_id")
    score = F.col("trail_m") / (1 + F.col("a.metres") / HALF_M)
    best = scored.groupBy("request_id").agg(F.min(F.struct((-score).alias("s"), "cluster_id", "a.node_id", "a.metres")).alias("b"))
    return best.select("request_id", "b.cluster_id", "b.node_id", "b.metres", (-F.col("b.s")).alias("score"))
