"""Route metrics, segments, cues and documents. Windows over (route_id, step) share one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopmill.functions import geo, text

#: Fixed value: a tenth of a mile in metres.
TINY_LOOP_M = 160.9344
#: Fixed value: characters of a course point's name that devices show.
COURSE_NAME_CHARS = 25


def along():
    return Window.partitionBy("route_id").orderBy("step")


def up_to_here():
    return along().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def measured(steps: DataFrame) -> DataFrame:
    """Adds distance, bearing, previous way and turn, running distance."""
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    out = steps.withColumns({"distance": geo.haversine(*ends), "bearing": geo.bearing(*ends)})
    out = out.withColumns({"before": F.lag("bearing").over(along()), "way_before": F.lag("way_id").over(along()), "so_far": F.sum("distance").over(up_to_here())})
    return out.withColumn("turn", geo.turn_kind(geo.angle_diff(F.col("bearing"), F.col("before")), F.coalesce(F.col("way_before") == F.col("way_id"), F.lit(True))))


def route_summary(steps: DataFrame, target_m: float = 5000.0) -> DataFrame:
    """Metrics of each route against its own `target_m`, or the given one where the steps have no such column; without a
    target (0 or less) the error is 0."""
    steps = steps if "target_m" in steps.columns else steps.withColumn("target_m", F.lit(target_m))
    again = F.row_number().over(Window.partitionBy("route_id", "way_id", "from_id", "to_id").orderBy("step"))
    m = measured(steps).withColumn("again", again)
    # a visit is tiny if its node was first reached less than a tenth of a mile before
    first = F.min("so_far").over(Window.partitionBy("route_id", "to_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    start = F.first("from_id").over(along())
    m = m.withColumns({"first_seen": first, "start": start})
    total, trail = F.sum("distance"), F.sum(F.when(F.col("is_trail"), F.col("distance")).otherwise(0.0))
    out = m.groupBy("route_id").agg(
        F.max("target_m").alias("target_m"), total.alias("distance_m"), trail.alias("trail_m"),
        F.count_distinct(F.when(F.col("to_signal"), F.col("to_id"))).alias("signal_count"),
        F.when(total > 0, 1 - F.sum(F.when(F.col("again") > 1, F.col("distance")).otherwise(0.0)) / total).otherwise(1.0).alias("new_street_fraction"),
        F.count_if(F.col("turn").isin("turn", "sharp")).alias("turn_count"), F.count_if(F.col("turn") == "sharp").alias("sharp_turn_count"),
        F.count_if((F.col("to_id") != F.col("start")) & (F.col("so_far") - F.col("first_seen") < TINY_LOOP_M)).alias("tiny_loop_count"),
    )
    share = F.when(F.col("distance_m") > 0, F.col("trail_m") / F.col("distance_m")).otherwise(0.0)
    out = out.withColumns({"trail_fraction": share, "error_m": F.when(F.col("target_m") > 0, F.abs(F.col("distance_m") - F.col("target_m"))).otherwise(0.0)})
    # fixed values: the coefficients of both scores
    size = 0.02 * F.col("distance_m") + 25 * share - 2 * F.col("signal_count") - 4 * F.col("turn_count") - 5 * F.col("sharp_turn_count") - 40 * F.col("tiny_loop_count")
    combined = F.col("error_m") / geo.METRES_PER_MILE + 0.004 * (F.col("turn_count") + F.col("sharp_turn_count")) - 0.18 * share + 1.2 * F.col("tiny_loop_count")
    return out.withColumns({"size_score": size, "combined_score": combined})


def no_reversal(steps: DataFrame) -> DataFrame:
    """(route_id, clean): no step runs a segment against an earlier step, steps on edges that are `exempt` (if there is such a column) aside."""
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    w = Window.partitionBy("route_id", "way_id", "low", "high").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    s = steps.withColumns({"low": low, "high": high, "up": F.col("from_id") <= F.col("to_id")})
    s = s.withColumn("against", F.coalesce(F.when(F.col("up"), F.max((~F.col("up")).cast("int")).over(w)).otherwise(F.max(F.col("up").cast("int")).over(w)), F.lit(0)))
    return s.groupBy("route_id").agg((F.max(F.when(F.col("exempt"), 0).otherwise(F.col("against")) if "exempt" in steps.columns else F.col("against")) == 0).alias("clean"))


def pass_stats(steps: DataFrame) -> DataFrame:
    n = steps.groupBy("route_id", "way_id", F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high")).count()
    return n.groupBy("route_id").agg(F.max("count").alias("max_passes"), F.count("*").alias("n_segments"))


def route_checks(steps: DataFrame) -> DataFrame:
    """(route_id, contiguous, closed), and uses_excluded where the steps have the flag `excluded`."""
    s = steps.withColumn("came", F.lag("to_id").over(along()))
    return s.groupBy("route_id").agg(F.bool_and(F.coalesce(F.col("came") == F.col("from_id"), F.lit(True))).alias("contiguous"), (F.min_by("from_id", "step") == F.max_by("to_id", "step")).alias("closed"), *([F.bool_or("excluded").alias("uses_excluded")] if "excluded" in steps.columns else []))


def segments(steps: DataFrame) -> DataFrame:
    """Consecutive steps of one name and trail flag, merged."""
    m = measured(steps)
    new = ~((F.lag("name").over(along()) == F.col("name")) & (F.lag("is_trail").over(along()) == F.col("is_trail")))
    m = m.withColumn("seq", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(up_to_here()))
    return m.groupBy("route_id", "seq", "name", "is_trail").agg(F.sum("distance").alias("distance_m"), F.count("*").alias("n_steps"))


def render_segments(steps: DataFrame) -> DataFrame:
    """Pass number of each undirected segment; later passes are shifted 3.5 m to the right each."""
    m = measured(steps).withColumn("pass", F.row_number().over(Window.partitionBy("route_id", "way_id", F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).orderBy("step")))
    side, by = F.pmod(F.col("bearing") + 90, F.lit(360.0)), (F.col("pass") - 1) * 3.5
    a, b = (geo.offset_point(F.col(f"lat{i}"), F.col(f"lon{i}"), side, by) for i in (1, 2))
    return m.select("route_id", "step", "pass", a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2"))


def turned() -> Column:
    """The side of a measured step's turn."""
    return F.when(geo.signed_turn(F.col("before"), F.col("bearing")) < 0, "Left").otherwise("Right")


def turn_notes(side: Column, name: Column) -> Column:
    return F.concat(F.lit("Turn "), side, F.lit(" onto "), name)


def course_cues(steps: DataFrame) -> DataFrame:
    """Start, every turn with its side and the next street, Finish."""
    m = measured(steps)
    turns = m.where(F.col("turn").isin("turn", "sharp")).select("route_id", F.col("step").alias("seq"), turned().alias("kind"), F.col("so_far") - F.col("distance"), "name")
    turns = turns.toDF("route_id", "seq", "kind", "at_m", "name").withColumn("notes", turn_notes(F.lower("kind"), F.col("name"))).drop("name")
    ends = m.groupBy("route_id").agg(F.max("step").alias("last"), F.max("so_far").alias("total"))
    start = ends.select("route_id", F.lit(-1).alias("seq"), F.lit("Start").alias("kind"), F.lit(0.0).alias("at_m"), F.lit("Start").alias("notes"))
    finish = ends.select("route_id", (F.col("last") + 1).alias("seq"), F.lit("Finish").alias("kind"), F.col("total").alias("at_m"), F.lit("Finish").alias("notes"))
    return start.unionByName(turns).unionByName(finish)


def bounding_boxes(steps: DataFrame) -> DataFrame:
    box = steps.groupBy("route_id").agg(*(f(F.col(c)).alias(f"{n}_{c[:3]}") for c in ("lat2", "lon2") for n, f in (("min", F.min), ("max", F.max))))
    return box.withColumn("span", F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(1e-6)))


#: Side and padding of a thumbnail.
THUMBNAIL, PADDING = 56.0, 5.0


def fitted_points(steps: DataFrame, size: float = THUMBNAIL) -> DataFrame:
    """(route_id, idx, x, y): the route's points in a square of `size`, one scale for both axes, centred, north up."""
    p = route_points(steps)
    box = p.groupBy("route_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    span = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-6))
    room = size - 2 * PADDING
    box = box.withColumns({"span_lat": span("lat"), "span_lon": span("lon")}).withColumn("scale", F.least(room / F.col("span_lon"), room / F.col("span_lat")))
    x = (size - F.col("span_lon") * F.col("scale")) / 2 + (F.col("lon") - F.col("min_lon")) * F.col("scale")
    y = size - ((size - F.col("span_lat") * F.col("scale")) / 2 + (F.col("lat") - F.col("min_lat")) * F.col("scale"))
    return p.join(box, "route_id").select("route_id", "idx", x.alias("x"), y.alias("y"))


def route_points(steps: DataFrame) -> DataFrame:
    """(route_id, idx, lat, lon, at_m): the start at 0, then the end of each step with the distance so far."""
    m = measured(steps)
    point = lambda i, lat, lon, at: F.struct(i.alias("idx"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), at.alias("at_m"))
    end = point(F.col("place"), "lat2", "lon2", F.col("so_far"))
    start = point(F.lit(0), "lat1", "lon1", F.lit(0.0))
    m = m.withColumn("place", F.row_number().over(along()))
    return m.select("route_id", F.explode(F.when(F.col("place") == 1, F.array(start, end)).otherwise(F.array(end))).alias("p")).select("route_id", "p.*")


#: The head of a document and the schema's namespace.
XML_HEAD, GPX_NAMESPACE = '<?xml version="1.0" encoding="UTF-8"?>', "http://www.topografix.com/GPX/1/1"


def to_gpx(steps: DataFrame) -> DataFrame:
    """(route_id, document) with one rtept for each point, the start first."""
    point = F.format_string('<rtept lat="%.6f" lon="%.6f"></rtept>', F.col("lat"), F.col("lon"))
    body = route_points(steps).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("idx", point.alias("x")))).alias("p"))
    named = steps.groupBy("route_id").agg(F.min_by("name", "step").alias("name"))
    name = text.xml_escape(F.col("name"))
    head = F.lit(f'{XML_HEAD}<gpx version="1.1" creator="loopmill" xmlns="{GPX_NAMESPACE}"><metadata><name>')
    return body.join(named, "route_id").select("route_id", F.concat(head, name, F.lit("</name></metadata><rte><name>"), name, F.lit("</name>"), F.concat_ws("", F.col("p.x")), F.lit("</rte></gpx>")).alias("document"))


def polyline_runs(steps: DataFrame) -> DataFrame:
    """(route_id, seq, is_trail, points): consecutive steps of one trail flag; from of the first, then every to."""
    new = F.coalesce(F.lag("is_trail").over(along()) != F.col("is_trail"), F.lit(True)).cast("int")
    m = steps.withColumn("seq", F.sum(new).over(up_to_here()))
    start = F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    runs = m.groupBy("route_id", "seq", "is_trail").agg(F.min_by(start, "step").alias("s"), F.sort_array(F.collect_list(F.struct("step", F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("p"))
    return runs.select("route_id", "seq", "is_trail", F.concat(F.array("s"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))).alias("points"))


def position(tag: str, lat: str, lon: str) -> Column:
    return F.format_string(f"<{tag}><LatitudeDegrees>%.6f</LatitudeDegrees><LongitudeDegrees>%.6f</LongitudeDegrees></{tag}>", F.col(lat), F.col(lon))


def to_tcx(steps: DataFrame) -> DataFrame:
    """(route_id, document): a course with a lap, a track point for each node and a course point for each cue.

    Track and cue texts are made a row each, of one pass over the measured steps, and put together by route in step order.
    """
    m = measured(steps)
    point = lambda place, metres: F.concat(F.lit("<Trackpoint>"), place, F.format_string("<DistanceMeters>%.1f</DistanceMeters></Trackpoint>", metres))
    cue = lambda kind, place, notes: F.concat(F.lit("<CoursePoint><Name>"), text.xml_escape(F.substring(notes, 1, COURSE_NAME_CHARS)), F.lit("</Name>"), place, F.lit("<PointType>"), kind, F.lit("</PointType><Notes>"), text.xml_escape(notes), F.lit("</Notes></CoursePoint>"))
    # a cue stands where its step begins; the last one where the route ends
    begin, end = position("Position", "lat1", "lon1"), position("Position", "lat2", "lon2")
    side, notes = turned(), turn_notes(F.lower(turned()), F.col("name"))
    at_turn = F.when(F.col("turn").isin("turn", "sharp"), F.struct("step", cue(side, begin, notes).alias("x")))
    ends = m.groupBy("route_id").agg(
        F.max("so_far").alias("total"), F.min_by(position("BeginPosition", "lat1", "lon1"), "step").alias("begin"), F.max_by(position("EndPosition", "lat2", "lon2"), "step").alias("end"), F.min_by("name", "step").alias("name"), F.min_by(point(begin, F.lit(0.0)), "step").alias("first"),
        F.min_by(begin, "step").alias("at0"), F.max_by(end, "step").alias("at1"), F.sort_array(F.collect_list(F.struct("step", point(end, F.col("so_far")).alias("x")))).alias("t"), F.sort_array(F.collect_list(at_turn)).alias("c"))
    start, finish = (cue(F.lit("Generic"), F.col(place), F.lit(word)) for place, word in (("at0", "Start"), ("at1", "Finish")))
    head = '<?xml version="1.0" encoding="UTF-8"?><TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Courses><Course><Name>'
    lap = F.concat(F.lit("<Lap><TotalTimeSeconds>0</TotalTimeSeconds>"), F.format_string("<DistanceMeters>%.1f</DistanceMeters>", "total"), F.col("begin"), F.col("end"), F.lit("</Lap><Track>"))
    return ends.select("route_id", F.concat(F.lit(head), text.xml_escape(F.col("name")), F.lit("</Name>"), lap, F.col("first"), F.concat_ws("", "t.x"), F.lit("</Track>"), start, F.concat_ws("", "c.x"), finish, F.lit("</Course></Courses></TrainingCenterDatabase>")).alias("document"))


def elevation_totals(profile: DataFrame) -> DataFrame:
    """profile(route_id, idx, elev): gain and loss over steps above a metre between known points, if half are known."""
    n = profile.groupBy("route_id").agg(F.count("*").alias("n"), F.count("elev").alias("known"))
    d = profile.where("elev is not null").withColumn("d", F.col("elev") - F.lag("elev").over(Window.partitionBy("route_id").orderBy("idx")))
    sums = d.groupBy("route_id").agg(F.sum(F.when(F.col("d") > 1, F.col("d")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < -1, -F.col("d")).otherwise(0.0)).alias("down"))
    ok = F.col("known") >= F.greatest(F.lit(2.0), F.col("n") / 2)
    return n.join(sums, "route_id", "left").select("route_id", ok.alias("available"), F.when(ok, F.col("up")).otherwise(0.0).alias("gain_m"), F.when(ok, F.col("down")).otherwise(0.0).alias("loss_m"))
