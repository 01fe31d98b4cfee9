"""Choosing between candidate routes: each function works on all requests at once.

candidates(request_id, i, within_tolerance, error_m, turn_count, tiny_loop_count, distance_m): i is the place in seed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.functions import geo

# Metres, turns a mile, seeds and rounds tried.
CLOSE_M, WORSE_M = 40.0, 150.0
MOST_TURNS_PER_MILE = 14.0
SEEDS, ROUNDS = 3, 4


def better(a: Column, b: Column) -> Column:
    """Whether a beats b: tolerance first, then an error smaller by over 40 m, then fewer turns. Not transitive."""
    by_error = F.abs(a["error_m"] - b["error_m"]) > CLOSE_M
    ranked = F.when(by_error, a["error_m"] < b["error_m"]).otherwise(a["turn_count"] < b["turn_count"])
    return F.when(a["within_tolerance"] != b["within_tolerance"], a["within_tolerance"]).otherwise(ranked)


def meaningfully_worse(new: Column, shown: Column) -> Column:
    return (shown["within_tolerance"] & ~new["within_tolerance"]) | (new["error_m"] - shown["error_m"] > WORSE_M)


def turns_per_mile(turns: Column, metres: Column, least_miles: float = 0.0) -> Column:
    """Null for a route without length, unless miles are floored."""
    miles = F.greatest(metres / geo.METRES_PER_MILE, F.lit(least_miles))
    return F.when(miles > 0, turns / miles)


def clean(x: Column) -> Column:
    return x["within_tolerance"] & (x["tiny_loop_count"] == 0) & F.coalesce(turns_per_mile(x["turn_count"], x["distance_m"]) <= MOST_TURNS_PER_MILE, F.lit(False))


def best_of_seeds(candidates: DataFrame) -> DataFrame:
    """The row kept after comparing the first seeds in order, stopping as soon as the kept one is clean.

    At most SEEDS rows a request are gathered: the order matters, so no sort can replace the fold.
    """
    fields = ["i", "within_tolerance", "error_m", "turn_count", "tiny_loop_count", "distance_m"]
    rows = candidates.where(F.col("i") < SEEDS).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))
    first = F.get("r", F.lit(0))
    kept = F.aggregate(F.slice("r", 2, SEEDS), first, lambda a, x: F.when(~clean(a) & better(x, a), x).otherwise(a))
    return rows.select("request_id", kept.alias("k")).select("request_id", "k.*")


def elevation_violation(available: Column, gain_m: Column, min_ft: Column, max_ft: Column) -> Column:
    """Feet outside of the wanted range (null: no wish); infinite where elevation is unknown."""
    feet = gain_m / geo.METRES_PER_FOOT
    short = F.coalesce(F.greatest(min_ft - feet, F.lit(0.0)), F.lit(0.0))
    over = F.coalesce(F.greatest(feet - max_ft, F.lit(0.0)), F.lit(0.0))
    return F.when(available, short + over).otherwise(F.lit(float("inf")))


def elevation_preferred(candidates: DataFrame) -> DataFrame:
    """(request_id, i, violation_ft, note) of the least violation; ties go to the earlier seed.

    candidates(request_id, i, available, gain_m, min_ft, max_ft). note: none, unavailable or unmatched.
    """
    v = elevation_violation(*(F.col(c) for c in ("available", "gain_m", "min_ft", "max_ft")))
    best = candidates.groupBy("request_id").agg(F.min(F.struct(v.alias("violation_ft"), "i")).alias("b"))
    note = F.when(F.col("b.violation_ft") == float("inf"), "unavailable").when(F.col("b.violation_ft") > 0, "unmatched").otherwise("none")
    return best.select("request_id", "b.i", "b.violation_ft", note.alias("note"))


def regenerated(shown: DataFrame, attempts: DataFrame) -> DataFrame:
    """(request_id, i): the first of ROUNDS attempts that isn't meaningfully worse than the shown row; null: keep it."""
    s = shown.select(F.col("request_id").alias("_r"), F.struct("within_tolerance", "error_m").alias("_s"))
    tried = attempts.where(F.col("i") < ROUNDS).withColumn("_a", F.struct("within_tolerance", "error_m"))
    good = s.join(tried, s["_r"] == tried["request_id"], "left")
    return good.groupBy(F.col("_r").alias("request_id")).agg(F.min(F.when(~meaningfully_worse(F.col("_a"), F.col("_s")), F.col("i"))).alias("i"))


def batch_stats(candidates: DataFrame) -> DataFrame:
    """Averages over a request's candidates, and how many have tiny loops."""
    rate = turns_per_mile(F.col("turn_count"), F.col("distance_m"), 0.1)
    return candidates.groupBy("request_id").agg(F.count("*").alias("n"), F.avg("turn_count").alias("turns"), F.avg(rate).alias("turns_per_mile"), F.count_if(F.col("tiny_loop_count") > 0).alias("with_tiny_loops"))


def lap_steps(base: DataFrame, lengths: DataFrame, target_m: float) -> DataFrame:
    """(route_id, lap, step, at) of whole laps of each base loop (route_id, step) of lengths(route_id, distance_m, n_steps).

    A loop longer than the target, or without length, gives no laps. `at` numbers the steps over all laps.
    """
    laps = F.when(F.col("distance_m") > 0, F.floor(target_m / F.col("distance_m"))).otherwise(0).cast("int")
    n = lengths.withColumn("laps", laps).where("laps > 0").select("route_id", "n_steps", F.explode(F.sequence(F.lit(1), F.col("laps"))).alias("lap"))
    return base.select("route_id", "step").join(n, "route_id").select("route_id", "lap", "step", ((F.col("lap") - 1) * F.col("n_steps") + F.col("step")).alias("at"))
