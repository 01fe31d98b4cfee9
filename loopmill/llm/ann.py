"""Approximate nearest neighbours by largest inner product: inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed. A query visits the
cells whose centroids it agrees with most, as many as hold RECALL of its own nearest vectors of the sample (few where vectors cluster, many
where they don't) and ENOUGH times as many other vectors as it needs, those of its nearest of the LONGEST vectors, and the cell it lies in itself; asymmetric distance tables bound the products with a cell's codes,
as each vector keeps how far its code is off, and all vectors that the bounds leave open are ranked by the exact product of the
original vectors: codes never lose a neighbour, however alike vectors are. Cells and the queries that visit them are cut into
blocks, so that no group outgrows a task, however many vectors are alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fit_in_task, join_small, materialize, process_cache, share, table

#: Documented bound of the sample the index is fitted on, and of the number of cells; vectors a cell.
TRAIN_ROWS, MIN_CELLS, MAX_CELLS, CELL_ROWS = 20_000, 16, 4096, 3000
#: The longest vectors, which many queries agree with most and a sample may miss: so many of them show queries the cells to visit.
LONGEST = 4096
#: Each query visits so many cells that they hold this share of its nearest vectors of the sample, and so many times k others in all.
RECALL, ENOUGH = 0.96, 4
#: Bytes of a code, and centroids of each.
PARTS, CENTROIDS = 16, 256
#: Vectors that are left open after the bounds are ranked at once if no more than this; else by a matrix product first.
RERANK = 128
#: Share of the norms by which products in single and in double precision may be off.
SINGLE, DOUBLE = 1e-5, 1e-12
#: Vectors, and queries, of one group.
BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    x = x.astype(np.float32)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = assign(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    def __init__(self, sample: np.ndarray, ids: np.ndarray, cells: int, long: np.ndarray | None = None, long_ids: np.ndarray | None = None, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.coarse = kmeans(sample, cells, 8, rng)
        self.sample, self.sample_ids, self.sample_cells = sample.astype(np.float32), ids, assign(sample, self.coarse)
        self.long, self.long_ids = (sample[:0], ids[:0]) if long is None else (long, long_ids)
        self.long_cells, self.long = assign(self.long, self.coarse), self.long.astype(np.float32)
        rest = self.split(sample - self.coarse[self.sample_cells])
        self.books = [kmeans(rest[:, m], CENTROIDS, 6, rng) for m in range(PARTS)]

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % PARTS
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), PARTS, -1).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and how far each code is off its vector at most, single precision included."""
        cell = assign(x, self.coarse)
        rest = self.split(x - self.coarse[cell])
        code = np.stack([assign(rest[:, m], self.books[m]) for m in range(PARTS)], 1).astype(np.uint8)
        decoded = np.stack([self.books[m][code[:, m]] for m in range(PARTS)], 1).astype(float)
        norm = lambda y: np.sqrt((y * y).sum((1, 2)))
        return cell, code, norm(rest - decoded) + SINGLE * (norm(decoded) + norm(rest.astype(float)))

    def ranking(self, q: np.ndarray) -> np.ndarray:
        """The cells, those a query agrees with most first."""
        return np.argsort(-(q.astype(np.float32) @ self.coarse.T), axis=1, kind="stable")

    def probes(self, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, counts: np.ndarray, fixed: int | None) -> list[np.ndarray]:
        """The cells each query visits. ids: the queries' ids; own: how many vectors have that id; counts: vectors by cell.

        A query goes down its ranked cells until they hold RECALL of its k nearest of the sample (or `fixed` cells),
        and on until they hold ENOUGH * k vectors of other ids, or all there are.
        """
        out = []
        for at in range(0, len(q), 256):
            part, who = q[at : at + 256], ids[at : at + 256]
            order = self.ranking(part)
            least = np.full(len(part), fixed or 1)
            if not fixed:
                agree = part.astype(np.float32) @ self.sample.T
                agree[who[:, None] == self.sample_ids] = -np.inf
                n = min(k, agree.shape[1])
                near = np.argpartition(-agree, n - 1, axis=1)[:, :n]
                place = np.take_along_axis(np.argsort(order, axis=1), self.sample_cells[near], 1)
                place[np.take_along_axis(agree, near, 1) == -np.inf] = 0
                least = np.sort(place, axis=1)[:, int(RECALL * n) if n > 1 else 0] + 1
            held = np.cumsum(counts[order], axis=1) < (own[at : at + 256] + ENOUGH * k)[:, None]
            home = assign(part, self.coarse)  # vectors like the query may be missing in the sample
            also = home[:, None]
            if len(self.long):
                agree = part.astype(np.float32) @ self.long.T
                agree[who[:, None] == self.long_ids] = -np.inf
                n = min(k, agree.shape[1])
                also = np.hstack((also, self.long_cells[np.argpartition(-agree, n - 1, axis=1)[:, :n]]))
            visited = [o[:n] for o, n in zip(order, np.maximum(least, held.sum(1) + 1), strict=True)]
            out += [v if fixed else np.concatenate((v, np.setdiff1d(a, v))) for v, a in zip(visited, also, strict=True)]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each part of a query with each centroid of that part."""
        parts = self.split(q)
        return np.stack([np.pad(parts[:, m] @ self.books[m].T, ((0, 0), (0, CENTROIDS - len(self.books[m])))) for m in range(PARTS)], 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: those with an id, finite and not zero. Shorter vectors are
    filled up with zeros to the length of the longest, which leaves all inner products as they are."""
    e = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    width = good.agg(F.max(F.size("v"))).first()[0] or 0
    return good.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def open_rows(about: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Indexes of all that may be among the k largest, where each is at most `slack` off `about`."""
    if len(about) <= k:
        return np.arange(len(about))
    least = np.partition(about - slack, len(about) - k)[len(about) - k]
    return np.flatnonzero(~(about + slack < least))


def neighbours(vectors: DataFrame, k: int, is_query, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors of (vec_id, embedding) of which the column expression is_query
    holds, against all others. Repeated ids are separate candidates, but never a query's own id; each row that repeats a
    query's id is a query of its own, with k rows. Vectors null, zero or with null or non-finite components, and null ids, take no
    part; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    data = materialize(usable(vectors), "ann-vectors")
    n = data.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    every = -(-n // TRAIN_ROWS)
    sample = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy(F.xxhash64("vec_id")).limit(TRAIN_ROWS).select("vec_id", "v", F.lit(False).alias("long"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = data.orderBy(F.desc(size), "vec_id").limit(LONGEST).select("vec_id", "v", F.lit(True).alias("long"))
    cells = max(MIN_CELLS, min(MAX_CELLS, n // CELL_ROWS))

    def trained(rows) -> Index | None:
        part: dict[bool, list] = {False: [], True: []}
        for r in rows:
            part[r["long"]].append((r["vec_id"], r["v"]))
        # a hash that leaves no vector in the sample leaves the longest
        fit, long = (([i for i, _ in p], [v for _, v in p]) for p in (part[False] or part[True], part[True]))
        return Index(np.array(fit[1]), np.array(fit[0]), cells, np.array(long[1]), np.array(long[0])) if part[True] else None

    name = f"ann {uuid.uuid4().hex}"
    shared = share(spark, fit_in_task(sample.unionByName(longest), trained, Index))

    def model() -> Index:
        return process_cache(name, shared)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, code, off = model().encode(matrix(pdf["v"]))
            yield pd.DataFrame({"cell": cell.astype("int32"), "vec_id": pdf["vec_id"], "v": pdf["v"], "code": [c.tobytes() for c in code], "off": off})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = model().probes(matrix(pdf["v"]), pdf["vec_id"].to_numpy(), pdf["own"].to_numpy(), k, counts, probes) if len(pdf) else []
            yield pd.DataFrame({"cell": [c.astype("int32") for c in cells], "query_id": pdf["vec_id"], "_q": pdf["_q"], "q": pdf["v"]}).explode("cell").astype({"cell": "int32"})

    index = materialize(data.mapInPandas(encoded, "cell int, vec_id long, v array<double>, code binary, off double"), "ann-index")
    counts = np.zeros(MAX_CELLS, np.int64)  # at most MAX_CELLS rows
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # a query's own id is never its neighbour, so vectors that repeat it don't count as found
    repeated = materialize(data.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1"), "ann-repeated")
    queries = join_small(data.where(is_query), repeated, "vec_id").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"), F.monotonically_increasing_id().alias("_q"))
    visits = materialize(queries.mapInPandas(probed, "cell int, query_id long, _q long, q array<double>"), "ann-visits")
    # numbers of blocks by cell: at most MAX_CELLS rows each
    cuts = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "cell")
    cuts = F.broadcast(cuts)
    left = index.join(cuts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("cell", "block", "q_block", "vec_id", "v", "code", "off")
    right = visits.join(cuts, "cell").withColumn("q_block", F.pmod(F.xxhash64("_q"), F.col("q_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "q_block", "query_id", "_q", "q")

    def ranked(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"])
            code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(-1, PARTS)
            off, size = rows["off"].to_numpy(), np.sqrt((x * x).sum(1))
            who, row, q = queries["query_id"].to_numpy(), queries["_q"].to_numpy(), matrix(queries["q"])
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                tables = model().tables(part)
                about = np.zeros((len(part), len(code)), np.float32)
                for m in range(PARTS if len(code) > max(RERANK, k) else 0):
                    about += tables[:, m][:, code[:, m]]
                for i in range(len(part)):
                    found, long = np.flatnonzero(ids != who[at + i]), np.sqrt((part[i] * part[i]).sum())
                    if len(code) > max(RERANK, k):
                        found = found[open_rows(about[i, found].astype(float), long * off[found], k)]
                    if len(found) > max(RERANK, k):
                        found = found[open_rows(x[found] @ part[i], DOUBLE * long * size[found], k)]
                    score = (x[found] * part[i]).sum(1)
                    best = np.lexsort((ids[found], -score))[:k]
                    out += zip([who[at + i]] * len(best), [row[at + i]] * len(best), ids[found][best].tolist(), score[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "_q", "vec_id", "score"]).astype({"query_id": "int64", "_q": "int64", "vec_id": "int64", "score": "float64"})

    near = left.groupBy("cell", "block", "q_block").cogroup(right.groupBy("cell", "block", "q_block")).applyInPandas(ranked, "query_id long, _q long, vec_id long, score double")
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)
