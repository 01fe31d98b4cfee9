"""Pieces the operators share: tables, materialised intermediates, joins on hot keys, components."""

from __future__ import annotations

import gc
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, newline, VT, FF and CR.
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a narrow table (a key and a few numbers) up to which it is broadcast; checked by a count.
BROADCAST_ROWS = 10_000
#: Ways in which a hot key is split when the small side is too large for a broadcast.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is made only where the session names none (tests, laptops)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loopmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also when body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_small(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join on one null-safe key to a narrow table with one row per key.

    Broadcast after a count shows at most BROADCAST_ROWS rows; otherwise the big side is salted and the
    small side repeated per salt, so that a hot key is spread over SALTS tasks.
    """
    other = small.withColumnRenamed(key, "_key")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(other), big[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    plain = [c for c, t in big.dtypes if not t.startswith(("map", "struct", "array", "variant"))]
    # from the row's own values, so that a task that runs again deals each row as it did before
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    right = other.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_salt2"])
    # by merge: repeated rows are more than Spark takes them for, so it might broadcast them
    return left.hint("merge").join(right, on, "left").drop("_key", "_salt", "_salt2")


def without(keep: list[str], made: str) -> list[str]:
    """The columns of keep whose names an operator's own columns (a DDL string) don't take; the others give way to those."""
    taken = {part.split()[0].lower() for part in made.split(", ")}
    return [c for c in dict.fromkeys(keep) if c.lower() not in taken]


def fit_in_task(sample: DataFrame, make: Callable, kind: type):
    """make(rows), a `kind`, for an iterator of the rows (dictionaries) of a bounded sample, computed in one task: rows and training
    arrays never reach the driver, only the model's attributes do, a few MB. None if make gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
        model = make(rows)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    if not found:
        return None
    model = kind.__new__(kind)
    vars(model).update(pickle.loads(found[0]["model"]))
    return model


def share(spark: SparkSession, model) -> Callable:
    """A function that gives the model inside tasks. Broadcast values are pickled by reference to this package, which executors may lack;
    so its bytes are broadcast, with their classes by value."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(shared.value)


def kept_here() -> dict:
    return sys.__dict__.setdefault("_loopmill_kept", {})


def make_room() -> None:
    """Frees the tables that this Python process keeps for other operators."""
    if kept_here():
        kept_here().clear()
        gc.collect()


def process_cache(key: str, make):
    """A value kept in this Python process, such as a tokenizer's tables, until another operator needs the room."""
    if key not in kept_here():
        make_room()
        kept_here()[key] = make()
    return kept_here()[key]


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of an edge table (a long, b long) as (node, component = smallest node).

    Alternating large-star and small-star steps: every step is one shuffle of at most the edge count,
    and O(log n) rounds are needed. Nodes without an edge are absent. A hub's neighbours are never gathered:
    a step only needs the minimum over a node's neighbours, which is pre-aggregated, then joined back by merge: nothing is broadcast.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        # large star: every neighbour larger than u is linked to the smallest of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = materialize(small, tag)
        # a forest of stars: no node is both a leaf and a centre, and no leaf has two centres
        done = small.select(F.col("v").alias("u")).distinct().hint("merge").join(small, "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty()
        now = small
        if done:
            centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres), tag)
