"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source repeats whole passes over its documents and takes a last,
partial pass: the documents whose hash lies under the source's threshold. Thresholds come from histograms
of words by source and 12 hash bits; only the bucket in which the budget ends is refined by the next bits.
Nothing is sorted, so budgets nest: a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, join_small, materialize, table

#: At most so many passes over a source.
MAX_PASSES = 3
#: Hash bits a level, and levels; together 60 bits, 15 hexadecimal digits of an MD5.
BITS, LEVELS = 12, 5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights 1, 2, 3, repeating, by code point with null last. Each round shares what capped sources leave
    among the others; only two sums a round reach the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    now = sizes.withColumn("weight", (1 + (F.row_number().over(order) - 1) % 3).cast("double")).withColumn("capped", F.lit(False))
    now = materialize(now, "mix-sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left = now.agg(F.sum(F.when(F.col("capped"), MAX_PASSES * F.col("source_size"))), F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
        unit = (total - (left[0] or 0)) / left[1] if left[1] else 0.0
        over = ~F.col("capped") & (F.col("weight") * unit > MAX_PASSES * F.col("source_size"))
        if now.where(over).isEmpty():
            share = F.when(F.col("capped"), (MAX_PASSES * F.col("source_size")).cast("double")).otherwise(F.col("weight") * unit)
            return now.select("source", "source_size", share.alias("target"))
        now = materialize(now.withColumn("capped", F.col("capped") | over), "mix-sources")


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below): the partial pass takes the hashes under `below`.

    docs: (source, size, h). goals: (source, source_size, target).
    """
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    open_ = goals.withColumn("passes", passes).withColumn("room", F.floor(F.col("target") - F.col("passes") * size).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        open_ = materialize(open_, "mix-level")
        inside = docs if level == 0 else join_small(docs, open_.select("source", "prefix"), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        pairs = histogram.withColumnRenamed("source", "s")
        along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # up to 4,096 buckets a source, whatever Spark guesses, so not broadcast
        seen = open_.hint("merge").join(pairs, open_["source"].eqNullSafe(pairs["s"]), "left").withColumn("sum", F.sum("n").over(along))
        fits = F.col("sum") <= F.col("room")
        # the end of the last bucket that fits as a whole is where the next level starts
        head = ["source", "source_size", "target", "passes", "room", "prefix"]
        step = seen.groupBy(*head).agg(F.max(F.when(fits, F.col("sum"))).alias("used"), F.min(F.when(~fits, F.col("bucket"))).alias("next"), F.min(F.when(~fits, F.col("sum"))).alias("past"))
        if level == LEVELS - 1:  # the document at which the budget ends comes in if that is nearer
            step = step.withColumn("next", F.col("next") + (F.col("past") - F.col("room") <= F.col("room") - F.coalesce("used", F.lit(0))).cast("long"))
        step = step.withColumn("next", F.coalesce("next", F.shiftleft(F.col("prefix") + 1, BITS) if level else F.lit(1 << BITS).cast("long")))
        open_ = step.select("source", "source_size", "target", "passes", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), F.col("next").cast("long").alias("prefix"))
    return open_.withColumnRenamed("prefix", "below").drop("room")


def slim_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h"))


def limits_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs, and thresholds(), both written out."""
    slim = materialize(slim_rows(docs), "mix-docs")
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    return slim, materialize(thresholds(slim.select("source", "size", "h"), goals), "mix-limits")


def times_taken() -> Column:
    times = F.col("passes") + F.when(F.col("passes") < MAX_PASSES, (F.col("h") < F.col("below")).cast("long")).otherwise(0)
    return F.when(F.col("size") > 0, times).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words, repeats counted), passes_taken.

    A null or empty text has size 0 and is never taken; a null source is a source of its own; rows with one
    doc_id share a hash and enter or stay out together (so do ties of hashes); an empty table gives no rows. Of a text only its number
    of words is used, counted over the whole text; other columns are ignored, whatever their names.
    """
    slim, limits = limits_of(docs)
    out = join_small(slim, limits, "source").withColumn("passes_taken", times_taken())
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes_taken")).alias("taken"), "passes_taken")


def mixed_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, a row as often as the mix takes it."""
    _, limits = limits_of(docs)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("source"), n_words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h"))
    taken = join_small(rows, limits, "source").withColumn("_times", times_taken().cast("int")).where("_times > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
