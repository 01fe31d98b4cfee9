"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

Equal strings of SHORT bytes or more hold the same least GRAM-byte hash at the same place (winnowing), so the starts of strings are
gathered by that anchor, and equal strings always meet. Contexts (the bytes that the starts of one anchor reach) that agree as a whole
are counted before anything is compared. What is left of an anchor's contexts is dealt into shards. A shard's transform is, for one column after
another from the right, the symbols before its suffixes in the order of those suffixes; dealing the suffixes stably by these symbols gives the order
one column further left. Two shards are merged by refining their interleave (which shard the next suffix comes from) in the same
way, from the two transforms alone: no suffix is sorted again. The last merge also carries the common prefixes of neighbours along;
intervals whose common prefixes reach LENGTH (or SHORT) are the repeated strings.

A merge of whole documents' transforms would refine every byte of the corpus several hundred times; here only strings that share
an anchor take part. An anchor of more than BLOCK contexts is dealt out by pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, table

#: Bytes of the strings that are removed, and of those that are only reported.
LENGTH, SHORT = 400, 272
#: Both powers of two: bytes of a hash, and bytes that one symbol of the columns right of the anchor holds.
GRAM, SYMBOL = 32, 8
#: Bytes that are scanned at once (their positions fit in POSITION bits).
CHUNK, POSITION = 1 << 20, 24
#: Contexts of one anchor that one group orders together; more are dealt out by pairs of blocks.
BLOCK = 2048
#: Contexts of a shard; a portion is closed at the first group's end with four times so many.
SHARD = 1024
#: `place` holds a run's start, its number n of starts (at most SHORT - GRAM + 1) and the anchor's offset (less than that) in one number.
ROW = "key long, context long, doc_key long, doc_id long, place long"
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hash(x: np.ndarray, doublings: int) -> np.ndarray:
    """Polynomial hash of every 2 ** doublings consecutive values."""
    for k in range(doublings):
        have = 1 << k
        x = x[:-have] * np.uint64(pow(int(BASE), have, 1 << 64)) + x[have:]
    return x


def least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every `size` consecutive values, by doubling."""
    have = 1
    n = len(x) - size + 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[size - have : size - have + n])


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For a whole document's bytes: arrays (key, context hash, place), one entry for each run of consecutive starts of
    SHORT-byte strings with the same anchor."""
    size = len(data)
    salt = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for at in range(0, max(0, size - SHORT + 1), CHUNK):
        part = data[at : at + CHUNK + SHORT - 1]
        grams = mixed(window_hash(salt[part], GRAM.bit_length() - 1))
        packed = (grams & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(grams), dtype=np.uint64)
        low = least(packed, SHORT - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        n = np.diff(np.append(first, len(low)))
        place = (low[first] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
        raw = data[at : at + CHUNK + LENGTH + SHORT].tobytes()
        context = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
        context = mixed(context ^ (n.astype(np.uint64) << np.uint64(32)) ^ (place - first).astype(np.uint64))
        yield grams[place].view(np.int64), context.view(np.int64), (first + at) << 16 | n << 8 | (place - first)


def unpacked(place) -> tuple:
    """Start, n and anchor offset; of a column or of an array."""
    if isinstance(place, Column):
        return F.shiftright(place, 16).cast("int"), F.shiftright(place, 8).bitwiseAND(F.lit(255)).cast("int"), place.bitwiseAND(F.lit(255)).cast("int")
    return place >> 16, place >> 8 & 255, place & 255


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), o


def scan(docs: DataFrame) -> DataFrame:
    """docs: (doc_key, doc_id, raw). One row of ROW for each run of string starts with one anchor."""

    names = StructType.fromDDL(ROW).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                for key, context, *rest in anchors(data[offsets[i] : offsets[i + 1]]):
                    k = len(key)
                    for o, v in zip(out, (key, context, np.full(k, keys[i], np.int64), np.full(k, ids[i], np.int64), *rest), strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=names)

    return docs.mapInArrow(run, ROW)


def columns_of(texts: list[bytes], anchor: np.ndarray) -> list[np.ndarray]:
    """The symbols of contexts, column by column from the right: LENGTH bytes from the anchor on, SYMBOL bytes a column, then the
    bytes before the anchor one by one (GONE where a context has none). Contexts end in zeros, which no string of a start reaches."""
    left, right = int(anchor.max()), LENGTH
    x = np.zeros((len(texts), left + right), np.uint8)
    gone = np.zeros(x.shape, bool)
    for i, (t, a) in enumerate(zip(texts, anchor.tolist(), strict=True)):
        part = t[: a + right]
        x[i, left - a : left - a + len(part)] = np.frombuffer(part, np.uint8)
        gone[i, : left - a] = True
    wide = np.ascontiguousarray(x[:, left:]).view(">u8").astype(np.uint64)
    out = [wide[:, k] for k in range(right // SYMBOL - 1, -1, -1)]
    single = np.where(gone[:, :left], GONE, x[:, :left]).astype(np.uint64)
    return out + [single[:, k] for k in range(left - 1, -1, -1)]


GONE = 256


class Transform:
    """A shard: its contexts' groups in order, and for each column the symbols before the suffixes in the suffixes' order."""

    def __init__(self, group: np.ndarray, columns: list[np.ndarray]):
        self.group, self.columns = group, columns


def deal(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The stable order of suffixes by group and symbol; they come ordered by group."""
    move = np.argsort(symbols, kind="stable")
    return move[np.argsort(group[move], kind="stable")] if len(group) and group[0] != group[-1] else move


def shard_transform(columns: list[np.ndarray], group: np.ndarray, members: np.ndarray) -> tuple[Transform, np.ndarray]:
    """The transform of the contexts `members`, and those in their first order, by group."""
    first = order = members[np.argsort(group[members], kind="stable")]
    out, by = [], group[order]
    for column in columns:
        symbols = column[order]
        out.append(symbols)
        order = order[deal(by, symbols)]
    return Transform(by, out), first


def interleave(a: Transform, b: Transform):
    """Refines which of the two shards each suffix comes from, one column a step, from their transforms alone. Yields the
    merged symbols of each column and how the suffixes move."""
    group = np.concatenate((a.group, b.group))
    start = np.argsort(group, kind="stable")
    group, from_b = group[start], start >= len(a.group)
    for x, y in zip(a.columns, b.columns, strict=True):
        symbols = np.empty(len(group), np.uint64)
        symbols[~from_b], symbols[from_b] = x, y
        move = deal(group, symbols)
        yield symbols, move
        from_b = from_b[move]


def merge(a: Transform, b: Transform) -> Transform:
    return Transform(np.sort(np.concatenate((a.group, b.group))), [symbols for symbols, _ in interleave(a, b)])


def common_prefixes(common: np.ndarray, group: np.ndarray, symbols: np.ndarray, move: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it after a step, from those before the step: where the symbols agree
    the least between the old places and `width` bytes more, else the bytes that the symbols share. 0 at a group's first."""
    s, g = symbols[move], group[move]
    out = np.zeros(len(move), np.int32)
    near = g[1:] == g[:-1]
    same = near & (s[1:] == s[:-1]) & (s[1:] != GONE if width == 1 else True)
    out[1:][same] = np.minimum(LENGTH, width + range_least(common, move[:-1][same] + 1, move[1:][same] + 1))
    if width > 1:
        part = near & ~same
        differ, shared = s[1:][part] ^ s[:-1][part], np.zeros(int(part.sum()), np.int32)
        for k in range(1, width):
            shared += differ < np.uint64(1 << 8 * (width - k))
        out[1:][part] = shared
    return out


def range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for each pair, a < b."""
    n, level, levels = b - a, x, [x]
    k = 1
    while 2 * k <= (n.max() if len(n) else 0):
        level = np.minimum(level[:-k], level[k:])
        levels.append(level)
        k *= 2
    out = np.empty(len(a), x.dtype)
    depth = np.frexp(n.astype(float))[1] - 1
    for d in range(len(levels)):
        on = depth == d
        if on.any():
            out[on] = np.minimum(levels[d][a[on]], levels[d][b[on] - (1 << d)])
    return out


def repeated_starts(texts: list[bytes], n: np.ndarray, m: np.ndarray, anchor: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in groups of one anchor each, as two tables of context by start: which of the n[i] starts of context i begin
    SHORT bytes, and which of the first m[i] begin LENGTH bytes, that another context of the group holds too.

    Start s of context i lies anchor[i] - s bytes before the anchor, so it is found as many steps left of the anchor's column. A start's string is
    repeated if a neighbour in order shares so many bytes at a start that it has.
    """
    columns = columns_of(texts, anchor)
    shards = [shard_transform(columns, group, np.arange(k, len(texts), parts)) for parts in [-(-len(texts) // SHARD)] for k in range(parts)]
    level, order = [t for t, _ in shards], [r for _, r in shards]
    while len(level) > 2:  # by twos; the last two are merged below
        level = [merge(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        order = [joined(group, *order[k : k + 2]) for k in range(0, len(order), 2)]
    last = level if len(level) == 2 else [level[0], Transform(group[:0], [c[:0] for c in columns])]
    order = joined(group, *order)
    by, common = group[order], np.zeros(len(order), np.int32)  # nothing read yet
    tables = np.zeros((len(texts), int(n.max())), bool), np.zeros((len(texts), int(n.max())), bool)
    wide = LENGTH // SYMBOL

    def mark(back: int) -> None:
        start = anchor[order] - back
        for table_, limit, least_ in ((tables[0], n, SHORT), (tables[1], m, LENGTH)):
            at = np.flatnonzero((start >= 0) & (start < limit[order]))
            if len(at) > 1:
                link = range_least(common, at[:-1] + 1, at[1:] + 1) >= least_
                at = at[np.concatenate((link, [False])) | np.concatenate(([False], link))]
                table_[order[at], start[at]] = True

    for step, (symbols, move) in enumerate(interleave(*last)):
        common = common_prefixes(common, by, symbols, move, SYMBOL if step < wide else 1)
        order = order[move]
        if step >= wide - 1:
            mark(step - wide + 1)
    return tables


def joined(group: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Contexts of shards in the first order of their merge: by group, the earlier shard first."""
    every = np.concatenate(parts)
    return every[np.argsort(group[every], kind="stable")]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


NO_ID = -(1 << 63)
FOUND = "doc_key long, doc_id long, start int, n int, m int"


def search(contexts: DataFrame, partitions: int) -> DataFrame:
    """contexts: (key, pair, doc_key, doc_id, place, bytes), grouped by (key, pair). Runs of repeated starts: of n
    starts of SHORT bytes, or of m starts of LENGTH bytes."""
    ordered = contexts.repartition(partitions, "key", "pair").sortWithinPartitions("key", "pair")

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            group = np.cumsum(np.concatenate(([0], (pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1]) | (pdf["pair"].to_numpy()[1:] != pdf["pair"].to_numpy()[:-1])))).astype(np.int64)
            # whole groups, some thousand contexts at a time
            cut = [0]
            ends = np.flatnonzero(np.diff(group)) + 1
            for e in [*ends.tolist(), len(pdf)]:
                if e - cut[-1] >= 4 * SHARD or e == len(pdf):
                    cut.append(e)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = pdf.iloc[a:b]
                texts, (starts, n, anchor) = part["bytes"].tolist(), unpacked(part["place"].to_numpy())
                m = np.clip(np.array([len(t) for t in texts]) - LENGTH + 1, 0, n)
                tables = repeated_starts(texts, n, m, anchor, group[a:b])
                for long, table_ in enumerate(tables):
                    for i in np.flatnonzero(table_.any(1)).tolist():
                        key, doc, start = part["doc_key"].iat[i], part["doc_id"].iat[i], int(starts[i])
                        out += [(key, doc, start + f, 0 if long else t - f, t - f if long else 0) for f, t in runs(table_[i])]
        return pd.DataFrame(out, columns=["doc_key", "doc_id", "start", "n", "m"]).astype({"doc_key": "int64", "doc_id": "int64", "start": "int32", "n": "int32", "m": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            same = ((pdf["key"] == pdf["key"].iloc[-1]) & (pdf["pair"] == pdf["pair"].iloc[-1])).to_numpy()
            rest = pdf[same].reset_index(drop=True)
            yield found(pdf[~same].reset_index(drop=True))
        if rest is not None:
            yield found(rest)

    return ordered.mapInPandas(run, FOUND)


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Joins (doc_key, doc_id, list of runs) to the texts and cuts the contexts' bytes, before a row is made of each."""
    lists = wanted.groupBy("doc_key", "doc_id").agg(F.collect_list(F.struct("key", "pairs", "place")).alias("runs"))
    cut = lambda r: F.struct(*(r[c].alias(c) for c in ("key", "pairs", "place")), F.substring(F.col("raw"), unpacked(r["place"])[0] + 1, unpacked(r["place"])[1] + LENGTH - 1).alias("bytes"))
    one = docs.join(lists, ["doc_key", "doc_id"]).select("doc_key", "doc_id", F.explode(F.transform("runs", cut)).alias("r"))
    return one.select("r.key", F.explode("r.pairs").alias("pair"), "doc_key", "doc_id", "r.place", "r.bytes")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, start, n, m): runs of n starts of SHORT-byte strings, and of m starts of LENGTH-byte strings, that also
    start elsewhere; m is -1 for all of the n starts from which LENGTH bytes can be read.

    docs: (doc_key, doc_id, raw), the key a hash of the bytes. Rows that agree in both are copies of each other.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(scan(docs), "repeats-anchors")
    same = found.groupBy("key", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc_key", "doc_id", "place")).alias("first"))
    same = materialize(same, "repeats-contexts")
    twice = same.where("copies > 1").select(F.col("key").alias("k"), F.col("context").alias("c"))
    whole = found.join(twice, (F.col("key") == F.col("k")) & (F.col("context") == F.col("c")), "left_semi").select("doc_key", "doc_id", *(c.alias(name) for c, name in zip(unpacked(F.col("place")), ("start", "n"), strict=False)), F.lit(-1).alias("m"))
    shared = same.groupBy("key").agg(F.count("*").alias("m"), F.min("copies").alias("least")).where("m > 1 and least = 1").select(F.col("key").alias("k"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    lead = same.join(shared, F.col("key") == F.col("k")).withColumn("block", F.pmod("context", F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    wanted = lead.select("key", pairs.alias("pairs"), "first.*")
    return whole.unionByName(search(cut_contexts(docs, wanted), partitions))


RESULT = "n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string, n_shared long"


def cover(size: int, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which of `size` bytes lie in strings of `length` bytes that begin at runs of n starts."""
    edge = np.zeros(size + 1, np.int32)
    a, k = start[n > 0], n[n > 0]
    np.add.at(edge, a, 1)
    np.add.at(edge, a + k + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, the kept bytes (as text where they are UTF-8,
    else with U+FFFD) or only their SHA-256, and n_shared: bytes in strings of SHORT bytes that also start elsewhere.

    Null text is empty. Texts under LENGTH bytes are kept whole. Repeated rows are copies, so each loses all
    strings of LENGTH bytes. Very long texts are scanned in chunks that overlap, none of it is left out; ties of hashes only mean that
    strings meet that turn out to differ; an empty table gives no rows. A null doc_id is allowed (it stands as the least long
    meanwhile). Other columns are ignored. The texts are dealt by document once: the join that cuts contexts and the last one
    share that exchange, since both read the same three columns, none of which can be null.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(F.xxhash64(raw).alias("doc_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), raw.alias("raw"))
    found = repeated(docs)
    lists = found.distinct().groupBy("doc_key", "doc_id").agg(F.collect_list(F.struct("start", "n", "m")).alias("runs"))
    rows = docs.join(lists, ["doc_key", "doc_id"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("_id"), "raw", *(F.col(f"runs.{c}").alias(c) for c in ("start", "n", "m")))
    out = StructType(rows.select(F.col("_id").alias("doc_id")).schema.fields + StructType.fromDDL(RESULT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, kept, digest, shared = [], [], [], [], [], []
            for text, *lists in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                data, removed, runs_, in_short = text.as_py(), 0, 0, 0
                size.append(len(data))
                if lists[0].is_valid and len(lists[0]):
                    start, n, m = (np.asarray(x.values, np.int64) for x in lists)
                    m = np.where(m < 0, np.clip(len(data) - LENGTH + 1 - start, 0, n), m)
                    long = cover(len(data), start, m, LENGTH)
                    removed, runs_, in_short = int(long.sum()), len(runs(long)), int(cover(len(data), start, n, SHORT).sum())
                    data = np.frombuffer(data, np.uint8)[~long].tobytes()
                gone.append(removed)
                spans.append(runs_)
                shared.append(in_short)
                kept.append(None if digests else data.decode("utf-8", "replace"))
                digest.append(hashlib.sha256(data).hexdigest())
            numbers = [pa.array(c, pa.int64()) for c in (size, gone, spans, shared)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers[:3], pa.array(kept, pa.string()), pa.array(digest, pa.string()), numbers[3]], names=out.names)

    return rows.mapInArrow(run, out)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), digests=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
