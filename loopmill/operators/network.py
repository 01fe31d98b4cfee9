"""Attributed directed edges and nodes from ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopmill.functions import geo
from loopmill.functions import tags as T


def way_segments(ways: DataFrame) -> DataFrame:
    """Consecutive references of each kept way, without a shuffle."""
    t = F.col("tags")
    kept = ways.where(T.is_kept(t) & (F.size("refs") > 1)).select("way_id", "refs", T.display_name(t).alias("name"), T.is_trail(t).alias("is_trail"), T.is_busy(t).alias("is_busy"), T.tag(t, "highway").alias("highway"))
    pairs = F.transform(F.slice("refs", 1, F.size("refs") - 1), lambda x, i: F.struct(x.alias("a"), F.get("refs", i + 1).alias("b")))
    return kept.select("way_id", "name", "is_trail", "is_busy", "highway", F.posexplode(pairs).alias("pos", "s")).select("*", "s.a", "s.b").drop("s")


def measured(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments of at least half a metre whose ends are known, with their distance."""
    a = nodes.select(F.col("node_id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    long = segments.join(a, "a").join(b, "b").withColumn("distance", geo.haversine(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))))
    return long.where((F.col("lat1") != F.col("lat2")) | (F.col("lon1") != F.col("lon2"))).where("distance >= 0.5")


def build_edges(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of every segment of at least half a metre whose ends are known; the first of a key stays."""
    long = measured(segments, nodes)
    end = lambda x, y, turn: F.struct(F.col(x).alias("from_id"), F.col(y).alias("to_id"), (2 * F.col("pos") + turn).alias("adj_seq"))
    both = long.select("way_id", "name", "is_trail", "is_busy", "highway", "distance", F.explode(F.array(end("a", "b", 0), end("b", "a", 1))).alias("e")).select("*", "e.*").drop("e")
    first = Window.partitionBy("way_id", "from_id", "to_id").orderBy("adj_seq")
    both = both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    key = lambda x, y: F.concat_ws("", F.col("way_id").cast("string"), F.lit(":"), F.col(x).cast("string"), F.lit(">"), F.col(y).cast("string"))
    return both.withColumns({"edge_key": key("from_id", "to_id"), "reverse_key": key("to_id", "from_id")})


def lengths(long: DataFrame) -> DataFrame:
    """(way_id, from_id, to_id, is_trail, distance) of the edges that build_edges makes of segments as of measured(): the first of a key stays."""
    end = lambda x, y, turn: F.struct(F.col(x).alias("from_id"), F.col(y).alias("to_id"), (2 * F.col("pos") + turn).alias("adj_seq"))
    both = long.select("way_id", "is_trail", "distance", F.explode(F.array(end("a", "b", 0), end("b", "a", 1))).alias("e"))
    return both.groupBy("way_id", "e.from_id", "e.to_id", "is_trail").agg(F.min_by("distance", "e.adj_seq").alias("distance"))


def build_nodes(segments: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every known node that a kept way refers to, with its degree and whether a busy road leaves it."""
    used = segments.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    out = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.count("*").alias("degree"), F.bool_or("is_busy").alias("has_busy_road"))
    return nodes.join(used, "node_id", "left_semi").join(out, "node_id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "has_busy_road": F.coalesce("has_busy_road", F.lit(False))})


def transition_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(highway, n, u_turns, unsafe) over every two of edges that meet, by the first's highway, without making the pairs: edges are counted by node.

    edges as of build_edges, where every edge has its reverse, so each turns back in one way; nodes(node_id, has_signal), of which each end is one. Crossing
    a node with a busy road and no signal is unless on a busy road before or after.
    """
    end = lambda node, came: F.struct(F.col(node).alias("node_id"), F.lit(came).alias("came"))
    ends = edges.select("highway", "is_busy", F.explode(F.array(end("to_id", 1), end("from_id", 0))).alias("e"))
    by_road = ends.groupBy("e.node_id", "highway").agg(F.sum("e.came").alias("came"), F.sum(F.when(F.col("is_busy"), 0).otherwise(F.col("e.came"))).alias("calm"), F.sum(1 - F.col("e.came")).alias("left"), F.count_if(F.col("is_busy") & (F.col("e.came") == 0)).alias("busy"))
    at = by_road.groupBy("node_id").agg(F.sum("left").alias("left"), F.sum("busy").alias("busy"), F.collect_list(F.struct("highway", "came", "calm")).alias("roads"))
    at = at.hint("merge").join(nodes.select("node_id", "has_signal"), "node_id").select("left", "busy", "has_signal", F.inline("roads")).where("came > 0 and left > 0")
    unsafe = F.when((F.col("busy") > 0) & ~F.col("has_signal"), F.col("calm") * (F.col("left") - F.col("busy"))).otherwise(0)
    return at.groupBy("highway").agg(F.sum(F.col("came") * F.col("left")).alias("n"), F.sum("came").alias("u_turns"), F.sum(unsafe).alias("unsafe"))


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("highway", "is_trail", "is_busy").agg(F.count("*").alias("n_edges"), F.round(F.sum("distance"), 1).alias("metres"))
