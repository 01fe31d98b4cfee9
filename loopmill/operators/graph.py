"""Iterated graph jobs: dead ends, components, distances. Every round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loopmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Written to the session's shared checkpoint folder (to `path`, if given) and read again."""
    path = path or f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: Column, tag: str, path: str | None = None) -> tuple[DataFrame, int]:
    """settled(df), and for how many of its rows `what` holds, counted as they are written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count_if(what).alias("n")), tag, path)
    return out, seen.get.get("n") or 0


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("from_id < to_id").select("way_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"), "distance")


def dead_end_spurs(links: DataFrame) -> DataFrame:
    """The links outside the multigraph's 2-core: leaves are peeled until none is left. Parallel links count each."""
    rest = settled(links, "peel")
    while True:
        ends = rest.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count().where("count = 1").select("n")
        keep = settled(rest.join(ends, rest["u"] == ends["n"], "left_anti").join(ends, rest["v"] == ends["n"], "left_anti"), "peel")
        if keep.count() == rest.count():
            return links.join(rest.select("way_id", "u", "v"), ["way_id", "u", "v"], "left_anti")
        rest = keep


def components(links: DataFrame) -> DataFrame:
    """(node_id, cluster_id): least node of each component.

    A round gives a node the least label of its neighbours, gives it to the node that its label names too, so that whole trees of labels are hung over
    at once, and takes the label of the label: rounds grow with the logarithm of a component. A round counts the labels that it changed as
    it writes them, and nothing is broadcast.
    """
    both = settled(links.select("u", "v").union(links.select("v", "u")).distinct(), "cc-links")
    label, changed = settled(both.select(F.col("u").alias("node_id")).distinct().withColumn("cluster_id", F.col("node_id")), "cc"), 1
    own = F.struct("node_id", F.col("cluster_id").alias("old"), F.least("cluster_id", "near").alias("to"))
    named = F.struct(F.col("cluster_id").alias("node_id"), F.lit(None).cast("long").alias("old"), F.col("near").alias("to"))
    while changed:
        near = both.hint("merge").join(label, both["v"] == label["node_id"]).groupBy("u").agg(F.min("cluster_id").alias("near"))
        met = label.hint("merge").join(near, label["node_id"] == near["u"]).select(F.explode(F.array(own, named)).alias("x")).select("x.*")
        hung = met.groupBy("node_id").agg(F.max("old").alias("old"), F.least(F.min("to"), F.max("old")).alias("to"))
        jump = hung.select(F.col("node_id").alias("j"), F.col("to").alias("jumped"))
        new = hung.hint("merge").join(jump, hung["to"] == jump["j"]).select("node_id", F.least("to", "jumped").alias("cluster_id"), "old")
        new, changed = counted(new, F.col("cluster_id") != F.col("old"), "cc")
        label = new.drop("old")
    return label


def network_distances(starts: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(request_id, node_id, metres) up to `reach`, for starts(request_id, node_id): only improved rows are extended."""
    hops = settled(edges.where(F.col("distance") <= reach).groupBy("from_id", "to_id").agg(F.min("distance").alias("d")), "dist-hops")
    best = settled(starts.withColumn("metres", F.lit(0.0)), "dist")
    front, n = best, 1
    while n:
        on = front.hint("merge").join(hops, front["node_id"] == hops["from_id"]).select("request_id", F.col("to_id").alias("node_id"), (F.col("metres") + F.col("d")).alias("metres")).where(F.col("metres") <= reach)
        on = on.groupBy("request_id", "node_id").agg(F.min("metres").alias("metres"))
        old = best.withColumnRenamed("metres", "old").hint("merge")
        front, n = counted(on.join(old, ["request_id", "node_id"], "left").where("old is null or metres < old - 1e-9").drop("old"), F.lit(True), "dist")
        if n:
            best = settled(best.union(front).groupBy("request_id", "node_id").agg(F.min("metres").alias("metres")), "dist")
    return best
