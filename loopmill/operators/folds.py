"""Ordered folds over the steps of a route, where a counter starts anew at each mark (a running sum can't say that)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopmill.functions import geo
from loopmill.operators.routes import measured

# Fixed values, in metres.
ARROW_SPACING, ARROW_START, ARROW_LEAST_EDGE = 220.0, 110.0, 5.0
POINT_SPACING, PASS_OFFSET = 25.0, 3.5


def ordered(steps: DataFrame) -> DataFrame:
    m = measured(steps)
    return m.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("step", "distance", "bearing", "lat1", "lon1", "lat2", "lon2"))).alias("s"))


def marked(rows: DataFrame, start: float, at_least: float, shortest: float, last_too: bool) -> DataFrame:
    """(route_id, mark): the steps at which the counter has reached at_least on an edge longer than `shortest`."""
    empty = F.struct(F.lit(start).alias("n"), F.array().cast("array<int>").alias("at"))

    def add(a, x):
        n = a["n"] + x["distance"]
        hit = (n >= at_least) & (x["distance"] > shortest)
        if last_too:
            hit = hit | (x["step"] == F.element_at(F.col("s"), -1)["step"])
        return F.struct(F.when(hit, 0.0).otherwise(n).alias("n"), F.when(hit, F.concat(a["at"], F.array(x["step"]))).otherwise(a["at"]).alias("at"))

    return rows.select("route_id", F.explode(F.aggregate("s", empty, add)["at"]).alias("mark"))


def direction_arrows(steps: DataFrame) -> DataFrame:
    """A midpoint and a bearing about every 220 m, with the trail flag and the pass over the segment; later passes are shifted to the right."""
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    m = measured(steps).withColumn("pass", F.row_number().over(Window.partitionBy("route_id", "way_id", low, high).orderBy("step")))
    at = marked(ordered(steps), ARROW_START, ARROW_SPACING, ARROW_LEAST_EDGE, False)
    m = m.join(at.withColumnRenamed("mark", "step"), ["route_id", "step"])
    lat, lon = (F.col("lat1") + F.col("lat2")) / 2, (F.col("lon1") + F.col("lon2")) / 2
    moved = geo.offset_point(lat, lon, F.pmod(F.col("bearing") + 90, F.lit(360.0)), (F.col("pass") - 1) * PASS_OFFSET)
    again = F.col("pass") > 1
    return m.select("route_id", "step", F.when(again, moved["lat"]).otherwise(lat).alias("lat"), F.when(again, moved["lon"]).otherwise(lon).alias("lon"), "bearing", "is_trail", "pass")


def decimated_points(steps: DataFrame) -> DataFrame:
    """(route_id, step, lat, lon): the start (step -1), then ends of steps kept at least every 25 m; the first and the last step always count."""
    kept = marked(ordered(steps), 1e18, POINT_SPACING, -1.0, True).withColumnRenamed("mark", "step")
    ends = steps.join(kept, ["route_id", "step"]).select("route_id", F.col("step").cast("int").alias("step"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    start = steps.groupBy("route_id").agg(F.min_by(F.struct("lat1", "lon1"), "step").alias("s")).select("route_id", F.lit(-1).alias("step"), F.col("s.lat1").alias("lat"), F.col("s.lon1").alias("lon"))
    return start.unionByName(ends)


def best_results(results: DataFrame) -> DataFrame:
    """Per key the result shown after all of (key, ts, seq, error_m): a new one replaces the shown one unless it leaves
    the tolerance of 0.05 mi or is worse by more than 150 m."""
    rows = results.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "error_m"))).alias("r"))
    tolerance = 0.05 * 1609.344
    worse = lambda a, x: ((a <= tolerance) & (x > tolerance)) | (x - a > 150)
    return rows.select("key", F.aggregate(F.slice("r", 2, F.size("r")), F.get("r", F.lit(0))["error_m"], lambda a, x: F.when(worse(a, x["error_m"]), a).otherwise(x["error_m"])).alias("error_m"))


def recent(results: DataFrame, n: int = 8) -> DataFrame:
    """The last n of each key."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq")))
    return results.withColumn("place", rank).where(F.col("place") <= n)
