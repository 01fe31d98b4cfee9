"""Language identification with string kernels.

A text is the set of its character n-grams of lengths 1 to N_MAX over lower-cased letters of any script, each run of
other characters read as one space, hashed to HASH_BITS bits; the kernel of two texts is the number of n-grams they share over the
geometric mean of their own numbers (blended spectrum, presence). Landmark texts give the Nyström map, on which one ridge regressor
per language is fitted. A batch is scored by matrix products: presence by landmark n-grams, then the map, then the regressors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fit_in_task, process_cache, share, table, without

N_MAX, HASH_BITS = 3, 18
#: Documented bounds of the sample a model is fitted on: rows a language, rows in all (a row a language at least). Texts are read whole.
TRAIN_ROWS, TRAIN_TOTAL, LANDMARKS, RIDGE = 400, 40_000, 64, 1e-3


def fold_table() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else the lower-case letter's code point."""
    out = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        low = chr(c).lower()[:1]
        if low and low.isalpha():
            out[c] = ord(low)
    return out


class Kernel:
    def __init__(self):
        self.fold = fold_table()
        self.seen = np.zeros(1 << HASH_BITS, bool)

    def mark(self, text: str) -> bool:
        """Sets `seen` at the n-grams of a whole text, and only there; says whether it has a letter."""
        self.seen[:] = False
        x = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        if x.size > 1:  # a run of non-letters is one
            x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        code = x = np.concatenate(([0], x, [0])).astype(np.uint64)
        for n in range(1, N_MAX + 1):
            if n > 1:
                code = (code[:-1] << np.uint64(21)) | x[n - 1 :]
            self.seen[((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)] = True
            if code.size < 2:
                break
        return bool(x.any())

    def grams(self, text: str) -> np.ndarray:
        self.mark(text)
        return np.flatnonzero(self.seen)

    def presence(self, texts: list[str], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts by vocabulary, their own numbers of n-grams, and whether they have a letter."""
        out, own, letters = np.zeros((len(texts), len(vocabulary)), np.float32), np.ones(len(texts), np.float32), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            letters[i] = self.mark(t)
            out[i] = self.seen[vocabulary]
            own[i] = np.count_nonzero(self.seen)
        return out, own, letters


class Model:
    """Landmark n-grams and the product of Nyström map and ridge weights."""

    def __init__(self, sets: list[np.ndarray], labels: list[str], seed: int = 3):
        """sets: the n-grams of each text."""
        self.classes = sorted(set(labels))
        rng = np.random.default_rng(seed)
        y = np.array([self.classes.index(x) for x in labels])
        marks = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: max(1, LANDMARKS // len(self.classes))] for c in range(len(self.classes))])
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
        self.marks = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for j, i in enumerate(marks):
            self.marks[np.searchsorted(self.vocabulary, sets[i]), j] = 1
        self.norm = np.sqrt(np.maximum(1, [len(sets[i]) for i in marks])).astype(np.float32)
        own = np.maximum(1, [len(s) for s in sets]).astype(np.float32)
        every = np.vstack([self.kernel(self.rows(sets[k : k + 256]), own[k : k + 256]) for k in range(0, len(sets), 256)])
        value, vector = np.linalg.eigh(every[marks].astype(float))
        keep = value > 1e-6 * value.max()
        self.map = vector[:, keep] / np.sqrt(value[keep])
        phi = every @ self.map
        mean = phi.mean(0)
        target = np.where(y[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        # every language weighs the same, however many rows it has
        w = 1 / np.bincount(y, minlength=len(self.classes))[y]
        c = phi - mean
        solved = np.linalg.solve(c.T @ (c * w[:, None]) + RIDGE * np.eye(c.shape[1]), c.T @ ((target - target.mean(0)) * w[:, None]))
        self.weights = (self.map @ solved).astype(np.float32)
        self.bias = target.mean(0) - mean @ solved

    def rows(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(self.vocabulary, s), len(self.vocabulary) - 1)
            out[i, at[self.vocabulary[at] == s]] = 1
        return out

    def kernel(self, presence: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (presence @ self.marks) / np.sqrt(own)[:, None] / self.norm

    def score(self, presence: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and a score from 0 to 1 (softmax of the regressors) for each text."""
        value = self.kernel(presence, own) @ self.weights + self.bias
        e = np.exp(4 * (value - value.max(1, keepdims=True)))
        best = value.argmax(1)
        return best, (e[np.arange(len(e)), best] / e.sum(1)).astype(float)


def trained(rows: Iterable[dict]) -> Model | None:
    kernel, sets, labels = Kernel(), [], []
    for r in rows:
        sets.append(kernel.grams(r["text"]).astype(np.int32))
        labels.append(r["lang"])
    return Model(sets, labels) if sets else None


def fit(docs: DataFrame) -> Model | None:
    """From (text, lang), whole texts: the rows of each language with the least hash of the text, TRAIN_ROWS a language and
    TRAIN_TOTAL in all. Rows without text or lang teach nothing, repeated rows count once, of texts with equal hashes
    the least is taken. None if no row has text and lang. Fitted in one task."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    narrow = rows.select("lang", "_h").distinct()
    languages = narrow.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(TRAIN_ROWS, TRAIN_TOTAL // max(1, languages)))
    # a few candidates per task first, so that a hot language is never in one task
    part = Window.partitionBy("lang", F.pmod("_h", F.lit(64))).orderBy("_h")
    narrow = narrow.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= 2 * each // 64 + 1).select("lang", "_h")
    keep = narrow.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= each).select("lang", "_h")
    chosen = rows.join(F.broadcast(keep) if languages <= TRAIN_TOTAL else keep, ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    return fit_in_task(chosen.repartition(1).sortWithinPartitions("lang", "_h"), trained, Model)


SCHEMA = "lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep`, lang_pred, score; `und` with score 0 if text is null or has no letter, or nothing was learned.

    Whole texts are read, whatever their length. Rows are handled alone: repeated rows get equal results, an empty table
    gives no rows; equal scores of two languages go to the first by name. Kept columns with a result's name give way.
    """
    rows = docs.select(*without(keep, SCHEMA), F.coalesce("text", F.lit("")).alias("_text"))
    out = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(SCHEMA).fields)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kernel = shared(), process_cache("langid kernel", Kernel)
        vocabulary = model.vocabulary if model else np.zeros(0, int)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                presence, own, letters = kernel.presence(part.column(part.num_columns - 1).to_pylist(), vocabulary)
                if model is None:
                    names, score = ["und"] * len(own), np.zeros(len(own))
                else:
                    best, score = model.score(presence, own)
                    names = [model.classes[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, score, 0.0)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=out.names)

    return rows.mapInArrow(run, out)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"))
    return predict(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"])
