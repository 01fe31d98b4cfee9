"""Addresses, elevation and snapping: tables looked up by key or by grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopmill.functions import geo, text
from loopmill.operators.graph import settled
from loopmill.operators.spatial import METRES_PER_DEGREE, dealt, of_spots, spots

# Rows a provider gives, suggestions shown, letters needed; shares of a segment that count as its ends.
GEOCODED_ROWS, SUGGESTED, PROVIDER_ROWS, LEAST_LETTERS = 5, 5, 15, 3
END_SHARE = 0.015


def geocode(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(request_id, display_name, lat, lon, reason) for requests(request_id, address).

    gazetteer(address, rank, lat, lon, display_name, house_number). An address typed with a number takes the first
    row with a house number, any other the first row. The gazetteer is reduced to a row an address before the join,
    so that a popular address never multiplies. reason: null, not_found or no_house_number.
    """
    key, place = text.normalize_query(F.col("address")), F.struct("display_name", F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))
    has = F.coalesce(F.col("house_number"), F.lit("")) != ""
    best = gazetteer.where(F.col("rank") < GEOCODED_ROWS).groupBy(key.alias("_k")).agg(F.min_by(place, "rank").alias("any"), F.min_by(place, F.when(has, F.col("rank"))).alias("numbered"))
    r = requests.withColumn("_k", key).join(best, "_k", "left")
    typed = F.coalesce(F.col("address").rlike(r"^\s*\d+"), F.lit(False))
    hit = F.when(typed, F.col("numbered")).otherwise(F.col("any"))
    return r.select("request_id", hit.alias("h"), F.when(F.col("any").isNull(), "not_found").when(typed & F.col("numbered").isNull(), "no_house_number").alias("reason")).select("request_id", "h.display_name", "h.lat", "h.lon", "reason")


def suggest(queries: DataFrame, features: DataFrame) -> DataFrame:
    """(query_id, place, label) for queries(query_id, query): up to five labels, each from its first feature.

    features(query, rank, housenumber, street, name, city, county, state, country, lon, lat). The labels of a query text
    are found once, then joined to all who typed it.
    """
    label = text.suggestion_label(*(F.col(c) for c in ("housenumber", "street", "name", "city", "county", "state", "country")))
    named = features.where(F.col("rank") < PROVIDER_ROWS).withColumns({"_k": text.normalize_query(F.col("query")), "label": label})
    named = named.where("label <> '' and housenumber <> '' and lat is not null and lon is not null")
    first = named.groupBy("_k", "label").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("rank", "label"))
    top = first.withColumn("place", place).where(F.col("place") <= SUGGESTED)
    q = queries.where(F.length(F.trim("query")) >= LEAST_LETTERS).withColumn("_k", text.normalize_query(F.col("query")))
    return q.join(top, "_k").select("query_id", "place", "label")


def elevation_lookup(points: DataFrame, elevation: DataFrame, per_degree: int = 1000) -> DataFrame:
    """points(lat, lon, ...) with elev of their cell, null where unknown. elevation(cell_lat, cell_lon, elev).

    Each point is joined to its cell's one row; a cell of very many points is left to the splitting of skewed joins.
    """
    p = points.withColumns({"cell_lat": F.round(F.col("lat") * per_degree).cast("long"), "cell_lon": F.round(F.col("lon") * per_degree).cast("long")})
    known = elevation.groupBy("cell_lat", "cell_lon").agg(F.max("elev").alias("elev"))
    return p.join(known, ["cell_lat", "cell_lon"], "left")


def snap_to_network(points: DataFrame, segments: DataFrame, cell: float = 0.005) -> DataFrame:
    """(point_id, way_id, a, b, t, metres, node_id) on the nearest segment; ties, to 0.1 mm, go to the least (way_id, a, b).

    points(point_id, lat, lon), segments(way_id, a, b, lat1, lon1, lat2, lon2). A segment lies in every cell its box
    touches. A point looks around its own cell; one whose find is farther than the ring is wide looks again on wider
    cells. node_id is text: an end of the segment if the foot is near it, else snap:way:a:b.
    """
    (left, who), found = spots(points), None  # points of one place look once
    none = segments.isEmpty()
    while True:
        span = lambda x, y: F.sequence(F.floor(F.least(x, y) / cell), F.floor(F.greatest(x, y) / cell))
        s = segments.withColumn("cy", F.explode(span("lat1", "lat2"))).withColumn("cx", F.explode(span("lon1", "lon2")))
        near = F.sequence(F.lit(-1), F.lit(1))
        p = left.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).select("point_id", "lat", "lon", (F.floor(F.col("lat") / cell) + F.col("_i")).alias("cy"), (F.floor(F.col("lon") / cell) + F.col("_j")).alias("cx"))
        foot = geo.project_to_segment(*(F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")))
        on = dealt(p, s, ["cy", "cx"], "point_id").withColumn("f", foot)
        best = on.groupBy("point_id", "lat", "lon").agg(F.min(F.struct(F.round("f.dist", 4).alias("metres"), "way_id", "a", "b", F.col("f.t").alias("t"))).alias("s"))
        sure = F.col("s.metres") <= cell * METRES_PER_DEGREE * F.cos(F.radians(F.least(F.abs("lat") + cell, F.lit(89.0))))
        hit = settled(best.where(sure | F.lit(cell > 180)).select("point_id", "s.*"), "snap")
        found = hit if found is None else found.unionByName(hit)
        left = settled(left.join(hit.select("point_id"), "point_id", "left_anti"), "snap-left")
        if none or cell > 180 or left.isEmpty():
            break
        cell *= 4
    name = F.concat_ws(":", F.lit("snap"), F.col("way_id").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return of_spots(found, who).withColumn("node_id", F.when(F.col("t") <= END_SHARE, F.col("a").cast("string")).when(F.col("t") >= 1 - END_SHARE, F.col("b").cast("string")).otherwise(name))


def split_segments(segments: DataFrame, snaps: DataFrame) -> DataFrame:
    """(way_id, a, b, from_t, to_t) pieces of every segment, cut at each inner foot; several on one are put in order.

    A window over (segment, t) chains the cuts, so no segment's snaps are gathered in one row.
    """
    key = ["way_id", "a", "b"]
    inner = snaps.where((F.col("t") > END_SHARE) & (F.col("t") < 1 - END_SHARE)).select(*key, "t")
    cuts = segments.select(*key, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(inner.join(segments.select(*key), key, "left_semi")).distinct()
    after = F.lead("t").over(Window.partitionBy(*key).orderBy("t"))
    return cuts.select(*key, F.col("t").alias("from_t"), after.alias("to_t")).where("to_t is not null")


def split_edges(edges: DataFrame, segments: DataFrame, snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with each cut segment's two directions replaced by those of its pieces, and the new nodes.

    Node ids are text in both. Several feet on one segment are chained in order, so a new node's id also holds its place: snap:way:a:b:t. Pieces keep the
    way, its name and flags. New nodes (node_id, lat, lon, has_signal, has_busy_road, degree) have no signal, are busy as the way is and have degree 2.
    edges(way_id, from_id, to_id, distance, name, is_trail, is_busy, ...); segments and snaps as in split_segments.
    """
    pieces = split_segments(segments, snaps).where((F.col("from_t") > 0) | (F.col("to_t") < 1))
    p = pieces.join(segments.select("way_id", "a", "b", "lat1", "lon1", "lat2", "lon2"), ["way_id", "a", "b"])
    text_of = lambda c: F.col(c).cast("string")
    name = lambda t: F.when(F.col(t) <= 0, text_of("a")).when(F.col(t) >= 1, text_of("b")).otherwise(F.concat_ws(":", F.lit("snap"), text_of("way_id"), text_of("a"), text_of("b"), F.format_string("%.6f", t)))
    at = lambda t, c: F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1"))
    p = p.withColumns({"m": name("from_t"), "n": name("to_t"), "mlat": at("from_t", "lat"), "mlon": at("from_t", "lon"), "nlat": at("to_t", "lat"), "nlon": at("to_t", "lon")})
    p = p.withColumn("metres", geo.haversine(*(F.col(c) for c in ("mlat", "mlon", "nlat", "nlon"))))
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    e = edges.withColumns({"_a": low, "_b": high})
    cut = p.select("way_id", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), F.col("a").alias("_from"), "m", "n", "metres", "nlat", "nlon", "to_t")
    ends = [c for c in edges.columns if c not in ("edge_key", "reverse_key", "from_id", "to_id", "distance")]
    key = lambda x, y: F.concat(text_of("way_id"), F.lit(":"), F.col(x), F.lit(">"), F.col(y))
    whole = e.join(cut.select("way_id", "_a", "_b").distinct(), ["way_id", "_a", "_b"], "left_anti").select(*ends, text_of("from_id").alias("from_id"), text_of("to_id").alias("to_id"), "distance")
    forth = F.col("from_id") == F.col("_from")
    halves = e.join(cut, ["way_id", "_a", "_b"]).select(*ends, F.when(forth, F.col("m")).otherwise(F.col("n")).alias("from_id"), F.when(forth, F.col("n")).otherwise(F.col("m")).alias("to_id"), F.col("metres").alias("distance"))
    both = whole.unionByName(halves)
    busy = edges.groupBy("way_id").agg(F.bool_or("is_busy").alias("has_busy_road"))
    nodes = cut.where("to_t < 1").select("way_id", F.col("n").alias("node_id"), F.col("nlat").alias("lat"), F.col("nlon").alias("lon")).join(busy, "way_id")
    nodes = nodes.select("node_id", "lat", "lon", F.lit(False).alias("has_signal"), "has_busy_road", F.lit(2).alias("degree"))
    return both.withColumns({"edge_key": key("from_id", "to_id"), "reverse_key": key("to_id", "from_id")}), nodes
