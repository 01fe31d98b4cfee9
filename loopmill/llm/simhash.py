"""Near-duplicates by SimHash fingerprints with pigeonring filtering.

A 64-bit fingerprint is a ring of SEGMENTS segments. If two differ in at most D bits, then for some starting
segment the differences of the next 1, 2, ... segments stay within 1, 2, ... shares of D / SEGMENTS. With D below
SEGMENTS the first segment of such a chain agrees and the first two differ in one bit at most; a pair
becomes a candidate on exactly that, is tested on the longer chains, and only then by the full distance.

Only distinct fingerprints are compared. Candidates meet by (first segment, second segment up to one changed
bit); within such a bucket a traversal compares a fingerprint only with those not reached yet and gives
the edges of a spanning forest, so that copies and dense groups never become pairs of each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import components, make_room, materialize, table, without

BITS = 4
SHINGLE = 4
SEED = 42
#: Bit offsets and lengths of the segments of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one bucket that one task compares at a time; larger buckets are dealt out by pairs of blocks.
BLOCK = 4096

SPACES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 values of the shingles; 0 for a text without words."""
    x = b" ".join([w for w in (text or "").encode("utf-8", "replace").translate(SPACES).split(b" ") if w])
    if not x:
        return 0
    ends = np.flatnonzero(np.frombuffer(x, np.uint8) == 32)
    starts, ends = [0, *(ends + 1).tolist()], [*ends.tolist(), len(x)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < SHINGLE:
        return digest(x, SEED)
    h = np.array([digest(x[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], "<u8")
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_ += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and fp (long, the 64 bits); a kept column named fp gives way."""
    rows = docs.select(*without(keep, "fp long"), F.col("text").alias("_text"))
    out = StructType(rows.drop("_text").schema.fields + StructType.fromDDL("fp long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            values = np.array([fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(values, pa.int64())], names=out.names)

    return rows.mapInArrow(run, out)


def segment(fp, k: int):
    at, n = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def chain_keys(fp) -> list:
    """Per starting segment the keys under which a fingerprint is filed: both segments as they are, and with
    one bit of the second left out. Two share a key exactly if the second segments differ in one bit at most."""
    out = []
    for k in range(len(SEGMENTS)):
        first, second, n = segment(fp, k), segment(fp, k + 1), SEGMENTS[(k + 1) % len(SEGMENTS)][1]
        head = F.lit(k).cast("long") * (1 << 40) + first * (1 << 20)
        for b in range(n):
            out.append(head + second.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << b))) + F.lit((b + 1) << 14))
    return out


def passes_chains(difference: np.ndarray) -> np.ndarray:
    """Whether, from some segment on, every chain's differences stay within its share of BITS (the pigeonring)."""
    n = [np.bitwise_count((difference >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int16) for at, size in SEGMENTS]
    ok, m = np.zeros(difference.shape, bool), len(SEGMENTS)
    for k in range(m):
        total, good = np.zeros(difference.shape, np.int16), np.ones(difference.shape, bool)
        for length in range(1, m + 1):
            total = total + n[(k + length - 1) % m]
            good &= total * m <= length * BITS
        ok |= good
    return ok


def near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Indexes of `others` at most BITS from `one`: chains first, then the full distance."""
    difference = others ^ one
    found = np.flatnonzero(passes_chains(difference))
    return found[np.bitwise_count(difference[found]) <= BITS]


def forest(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph of x; indexes."""
    rest, edges = np.arange(len(x)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = near(x[at], x[rest])
            if len(hit):
                found = rest[hit].tolist()
                edges += [(at, f) for f in found]
                queue += found
                rest = np.delete(rest, hit)
    return edges


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of the link graph over the distinct values of `fp`.

    Buckets of up to BLOCK fingerprints are one group. A larger bucket is cut into blocks by the hash of the
    fingerprint, every two blocks are a group, so that no group exceeds 2 * BLOCK or so and none is dropped.
    A fingerprint has some sixty keys, which Spark's guess of a size leaves out, so neither side is broadcast.
    """
    keyed = distinct.select("fp", F.explode(F.array(*chain_keys(F.col("fp")))).alias("key"))
    counts = keyed.groupBy("key").count().where("count > 1")
    counts = counts.select(F.col("key").alias("k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    keyed = keyed.hint("merge").join(counts, F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    groups = keyed.select("key", F.explode(pair).alias("pair"), "fp")

    def edges_of(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy().view(np.uint64)
        key, pair = pdf["key"].to_numpy(), pdf["pair"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), [True])))
        pairs = cuts[:-1][np.diff(cuts) == 2]  # most groups: all at once
        difference = x[pairs] ^ x[pairs + 1]
        pairs = pairs[passes_chains(difference)]
        pairs = pairs[np.bitwise_count(x[pairs] ^ x[pairs + 1]) <= BITS]
        out = list(zip(pairs.tolist(), (pairs + 1).tolist(), strict=True))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 2:
                out += [(a + i, a + j) for i, j in forest(x[a:b])]
        i = np.array(out, np.int64).reshape(-1, 2)
        v = x.view(np.int64)
        return pd.DataFrame({"a": v[i[:, 0]], "b": v[i[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows; the last group of a batch waits for the next batch."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            same = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["pair"] == pdf["pair"].iloc[-1])
            rest = pdf[same].reset_index(drop=True)
            yield edges_of(pdf[~same].reset_index(drop=True))
        if rest is not None:
            yield edges_of(rest)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "fp").mapInPandas(run, "a long, b long")


def members(distinct: DataFrame) -> DataFrame:
    """(fp, component) from distinct values of fp; a component is named by its least fingerprint."""
    found = components(links(distinct), "simhash-cc")
    return distinct.hint("merge").join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def classes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` (doc_id among them), fp and component_id: the least doc_id that links lead to.

    Null and empty texts and texts without words have fingerprint 0 and are linked like others; rows without a
    doc_id never give the component's id unless all are without (then it is null). Repeated rows are repeated, texts of any
    length are read whole, ties can't matter; an empty table gives no rows. Kept columns named fp or component_id give way.
    """
    prints = materialize(fingerprints(docs, without(keep, "component_id long")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    member = members(distinct.select("fp")).hint("merge").join(distinct, "fp")
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of = member.hint("merge").join(least, "component").select("fp", "component_id")
    return spread(prints, of)


def one_of_each(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, one row of each component: the least by doc_id (null last), then by the hash of the row.

    Rows are compared by their links only: different texts under one doc_id that aren't linked both stay, and linked rows without
    a doc_id leave one. Texts without words are one component. An empty table gives no rows.
    """
    plain = [c for c, t in docs.select(*keep).dtypes if not t.startswith(("map", "variant"))]
    rows = docs.select(*keep, F.xxhash64(*plain).alias("_row"))
    prints = materialize(fingerprints(rows, [*without(keep, "fp long"), "_row"]), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")).alias("best")
    distinct = materialize(prints.groupBy("fp").agg(best), "simhash-distinct")
    first = members(distinct.select("fp")).hint("merge").join(distinct, "fp").groupBy("component").agg(F.min(F.struct("best", "fp")).alias("first"))
    first = materialize(first.select(F.col("first.fp").alias("fp"), F.col("first.best._row").alias("_row")), "simhash-first")
    return prints.hint("merge").join(first, ["fp", "_row"], "left_semi").dropDuplicates(["fp", "_row"]).drop("fp", "_row")


def spread(prints: DataFrame, of: DataFrame) -> DataFrame:
    """Joins each fingerprint's class to the rows. A fingerprint of very many copies is salted."""
    salts = 16
    left = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("merge").join(right, ["fp", "_salt"], "left").drop("_salt")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
