"""Near-duplicates by MinHash signatures, joined by a multi-index on their Hamming distance and confirmed on full shingle sets.

A signature has SYMBOLS minima of BITS bits. Two texts of similarity 0.85 differ in a symbol with odds of at most 0.15, so in more than MOST of
SYMBOLS with odds below one in a million; pairs within MOST are found without exception: the signature is cut into CHUNKS, of which
one has at most MOST // CHUNKS = 1 error (pigeonhole), and a chunk is filed once for each symbol that may be wrong, with that one left out.

Copies are one text. Texts that share a key also share the key's least text, so they meet again under that one, once for all their common keys.
There a traversal gives a spanning forest of the pairs within MOST; its components, which no link leaves, are where full sets are compared,
again by a traversal that looks at a text only until it is reached. So neither step emits each pair of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, make_room, materialize, table
from .simhash import SPACES

SHINGLE = 5
#: Texts are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
SYMBOLS, BITS = 64, 16
#: Most symbols that differ, and chunks: CHUNKS * 2 > MOST, so one chunk has one error at most.
MOST, CHUNKS = 27, 14
#: Texts (and bytes of text) of one group that one task compares at a time; larger groups are dealt out by pairs of blocks, so none is dropped.
BLOCK, BLOCK_BYTES = 2048, 16 << 20

_rng = np.random.default_rng(13)
FACTORS, MIXERS = (_rng.integers(1 << 63, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: First symbol of each chunk, and the end.
CUTS = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]


def normal(text: str | None) -> bytes:
    """The words in lower case (A-Z only), one space between."""
    return b" ".join([w for w in (text or "").encode("utf-8", "replace").translate(SPACES).split(b" ") if w])


def shingles(words: bytes) -> set[bytes]:
    """The distinct shingles of normal text: all words together if they are too few, none without words."""
    if not words:
        return set()
    starts, ends = bounds(words)
    return {words[a:b] for a, b in zip(starts, ends, strict=False)}


def bounds(words: bytes) -> tuple[list[int], list[int]]:
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(words)]
    return starts, ends[SHINGLE - 1 :] or [len(words)]


def signature(found: set[bytes]) -> np.ndarray:
    """The symbols of a shingle set."""
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(x) for x in found], np.uint64)
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        x = h[at : at + 2048, None] * FACTORS
        x ^= x >> np.uint64(32)
        x *= MIXERS
        np.minimum(least, x.min(0), out=least)
    return (least ^ (least >> np.uint64(29)) ^ (least >> np.uint64(47))).astype("<u2")


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """For each signature (row) and symbol the key of the symbol's chunk with that symbol left out."""
    out = np.empty(symbols.shape, np.uint64)
    for a, b in zip(CUTS[:-1], CUTS[1:], strict=True):
        for k in range(a, b):
            h = np.full(len(symbols), k + 1, np.uint64) * MIXERS[k]
            for other in (*range(a, k), *range(k + 1, b)):
                h = (h ^ symbols[:, other]) * FACTORS[other]
                h ^= h >> np.uint64(31)
            out[:, k] = h
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bytes, symbols) of every row; the last three are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sizes, digests, lengths, symbols = [], [], [], []
            for text in batch.column(1):
                words = normal(text.as_py())
                found = shingles(words)
                sizes.append(len(found))
                digests.append(hashlib.sha256(words).digest()[:16] if found else None)
                lengths.append(len(words) if found else None)
                symbols.append(signature(found).tobytes() if found else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array(symbols, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bytes", "symbols"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bytes long, symbols binary")


def keyed(distinct: DataFrame) -> DataFrame:
    """(node, key), SYMBOLS rows a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS)), pa.array(keys.ravel())], names=["node", "key"])

    return distinct.select("node", "symbols").mapInArrow(run, "node long, key long")


def matrix(symbols: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(symbols), "<u2").reshape(-1, SYMBOLS)


def forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n items; near(i, rest) says which of rest are linked to i. Only items not reached yet are looked at."""
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = near(at, rest)
            found = rest[hit].tolist()
            edges += [(at, f) for f in found]
            queue += found
            rest = rest[~hit]
    return edges


def blocked(groups: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Rows of groups with `pair`, once for every pair of blocks that a row's block is in; blocks(group, blocks) are the numbers of blocks."""
    dealt = groups.join(blocks, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    return dealt.withColumn("pair", F.explode(pair)).drop("block", "blocks")


def by_group(rows: DataFrame, group: str, links_of) -> DataFrame:
    """(a, b): the links that links_of(columns of one group's rows) gives as pairs of places, by `group` and `pair`. rows start with these two and node."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        now, held = None, []
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            a, b = [], []
            for row in zip(*columns, strict=True):
                if row[:2] != now:
                    add(held, a, b)
                    now, held = row[:2], []
                held.append(row[2:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = [], []
        add(held, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def add(held: list[tuple], a: list, b: list) -> None:
        if len(held) > 1:
            nodes = [row[0] for row in held]
            for i, j in links_of(*zip(*held, strict=True)):
                a.append(nodes[i])
                b.append(nodes[j])

    return rows.repartition(n, group, "pair").sortWithinPartitions(group, "pair").mapInArrow(run, "a long, b long")


def near_signatures(nodes: tuple, sizes: tuple, symbols: tuple) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within MOST whose sizes allow a link."""
    x, n = matrix(list(symbols)), np.array(sizes)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])).copy()
        fits[fits] = (x[rest[fits]] != x[i]).sum(1) <= MOST
        return fits

    return forest(len(x), near)


def near_sets(nodes: tuple, words: tuple) -> list[tuple[int, int]]:
    """A spanning forest of the links. Sets are compared by their shingles' hashes; each link found is confirmed on the shingles themselves."""
    digest = xxhash.xxh3_64_intdigest
    words = [zstandard.decompress(w) for w in words]
    hashes = [np.array([digest(s) for s in shingles(w)], np.uint64) for w in words]
    n = np.array([len(h) for h in hashes])
    values, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    starts, own = np.concatenate(([0], np.cumsum(n))), np.zeros(len(values), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])).copy()
        some = rest[fits]
        if len(some):
            mine = ids[starts[i] : starts[i + 1]]
            own[mine] = True
            size = n[some]
            at = np.repeat(starts[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.add.reduceat(own[ids[at]].astype(np.int64), np.cumsum(size) - size)
            own[mine] = False
            fits[fits] = [linked(both[k], n[i], size[k]) and confirmed(words[i], words[some[k]]) for k in range(len(some))]
        return fits

    return forest(len(words), near)


def linked(both: int, one: int, other: int) -> bool:
    return 100 * both >= PERCENT * (one + other - both)


def confirmed(one: bytes, other: bytes) -> bool:
    a, b = shingles(one), shingles(other)
    return linked(len(a & b), len(a), len(b))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) for wanted(node, digest, first): one row a text, of the row that names it; so copies aren't moved together. words are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            words = [normal(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(w).digest()[:16] for w in words], pa.binary()), pa.array([zstandard.compress(w) for w in words], pa.binary())], names=["doc_id", "digest", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "doc_id long, digest binary, words binary")
    # a list that grows with the texts isn't broadcast, whatever size is guessed for it
    w = wanted.select("node", F.col("digest").alias("_digest"), "first").hint("merge")
    found = rows.join(w, (rows["digest"] == w["_digest"]) & rows["doc_id"].eqNullSafe(w["first"])).select("node", "words")
    return found.dropDuplicates(["node"])


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all links over distinct(node, first, digest, n_shingles, bytes, symbols)."""
    rows = keyed(distinct)
    least = rows.groupBy("key").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("_key"), "m")
    star = rows.join(least, F.col("key") == F.col("_key")).select("m", "node").distinct()
    star = materialize(star, "minhash-stars")
    blocks = star.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    met = blocked(star, "m", blocks).join(distinct.select("node", "n_shingles", "symbols"), "node").select("m", "pair", "node", "n_shingles", "symbols")
    coarse = components(by_group(met, "m", near_signatures), "minhash-near")
    own = materialize(coarse.join(distinct.select("node", "first", "digest", "bytes"), "node"), "minhash-own")
    blocks = own.groupBy("component").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    blocks = blocks.select("component", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("b") / BLOCK_BYTES)).cast("int").alias("blocks"))
    words = materialize(texts_of(docs, own), "minhash-texts")
    met = blocked(own.select("component", "node"), "component", blocks).join(words, "node").select("component", "pair", "node", "words")
    return by_group(met, "component", near_sets)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a row of docs.

    component_id is the least doc_id that links lead to. Null texts and texts without words have no shingles and are linked with nothing, each its own component.
    Repeated rows are one text and each keep their row; a null doc_id names a component only if all its rows have none (then it is null), and such rows
    aren't kept. Texts of any length are read whole; ties can't matter; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(signed(docs), "minhash-rows")
    distinct = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("n_shingles", "bytes", "symbols")))
    # numbered as it is written, so that the numbers hold
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "minhash-distinct")
    found = components(links(docs, distinct), "minhash-cc")
    member = distinct.select("node", "digest", "first", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("texts"))
    of = member.join(least, "component").where("texts > 1 or copies > 1").select(F.col("digest").alias("_digest"), "component_id")
    salts = 16
    left = rows.select("doc_id", "n_shingles", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"))
    right = of.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = left.join(right, (left["digest"] == right["_digest"]) & (left["_salt"] == right["_salt2"]), "left")
    first = F.coalesce("component_id", F.when(F.col("_digest").isNull(), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", first.alias("component_id"), F.coalesce(F.col("doc_id") == first, F.lit(False)).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
