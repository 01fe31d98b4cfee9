"""Toxicity by a subsequence string kernel.

A text is the set of its words; the kernel of two words is the gap-weighted subsequence kernel of order ORDER
(each common subsequence weighs DECAY to the power of the letters it spans in both), normalised, so that gaps
and inserted characters cost little. Landmark words give the Nyström map, on which a squared-hinge support
vector machine is trained from labelled texts: a toxic text needs one toxic word at least, a clean one has none
(multiple instances). A text's score is a logistic function of its highest word scores.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fit_in_task, make_room, share, table, without

ORDER, SPAN, DECAY = 4, 7, 0.7
#: Subsequences are hashed to so many bits.
HASH_BITS = 20
#: A word is taken with a mark before and after it.
FIRST, LAST = 0, 27
#: Words longer than this are scored in windows of that length that overlap by half.
LONGEST = 40
#: Documented bounds of the sample that the model is fitted on: labelled texts a class, words a class.
TRAIN_ROWS, TRAIN_WORDS, LANDMARKS = 2500, 12_000, 240
#: A word starts as toxic if its number of toxic texts times the log of its lift reaches this (else chance will do). Chosen by
#: the log loss of four folds of the rows that op10 may learn from.
EVIDENCE = 32.0
#: Words of a portion and of each of the two tables of scores that a process keeps.
MAX_WORDS = 100_000
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.*_-]{1,3}){3,}[^\W\d_](?!\w)")
NO_LETTER = re.compile(r"[\W\d_]+")


def letters(word: str) -> np.ndarray:
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 28 + points % 36)


def shapes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the subsequences of a word of n letters."""
    tails = [(0, *t) for t in itertools.combinations(range(1, SPAN), ORDER - 1)]
    at = np.array([[s + i for i in t] for s in range(n) for t in tails if s + t[-1] < n], np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)


class Subsequences:
    """Feature codes and values of words of equal length, normalised."""

    def __init__(self):
        self.shapes: dict[int, tuple] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words[0])
        if n not in self.shapes:
            self.shapes[n] = shapes(n + 2)
        at, weight = self.shapes[n]
        x = letters("".join(words)).reshape(len(words), n)
        x = np.hstack([np.full((len(x), 1), FIRST), x, np.full((len(x), 1), LAST)])
        code = np.zeros((len(words), len(at)), np.uint64)
        for k in range(ORDER):
            code = code * np.uint64(64) + x[:, at[:, k]].astype(np.uint64)
        code = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
        order = np.argsort(code, axis=1, kind="stable")
        code, value = np.take_along_axis(code, order, 1), weight[order]
        # the square of a code's summed weight: pair products within runs of equal codes
        first = np.ones(code.shape, bool)
        first[:, 1:] = code[:, 1:] != code[:, :-1]
        flat = np.flatnonzero(first)
        sums = np.add.reduceat(value.ravel(), flat) if flat.size else np.zeros(0)
        norm = np.sqrt(np.bincount(flat // max(1, code.shape[1]), sums * sums, minlength=len(words)))
        return code, value / np.maximum(norm, 1e-9)[:, None]


def pieces(word: str) -> list[str]:
    """The letters of a word, in windows if it is long."""
    x = NO_LETTER.sub("", word)
    if len(x) <= LONGEST:
        return [x] if len(x) + 2 >= ORDER else []  # with its two marks
    return [x[i : i + LONGEST] for i in range(0, len(x) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    for m in SPACED.finditer(low):  # letters set apart by spaces or signs
        found.add(NO_LETTER.sub("", m.group()))
    return found


def portions(bags: Iterable[Collection[str]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Indexes of texts and their words, in portions of at most MAX_WORDS words; a text of more is cut."""
    part, size = [], 0
    for i, bag in enumerate(bags):
        words = list(bag)
        for k in range(0, len(words), MAX_WORDS):
            some = words[k : k + MAX_WORDS]
            if size + len(some) > MAX_WORDS:
                yield part
                part, size = [], 0
            part.append((i, some))
            size += len(some)
    if part:
        yield part


class WordScores:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.features = weights, bias, Subsequences()
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def rate(self, words: set[str]) -> dict[str, float]:
        """Scores of words; without a letter sequence the score is the least, -1."""
        by_length: dict[int, list] = {}
        best: dict[str, float] = {}
        for w in words:
            best[w] = -1.0
            for p in pieces(w):
                by_length.setdefault(len(p), []).append((w, p))
        for group in by_length.values():
            for k in range(0, len(group), 1024):
                part = group[k : k + 1024]
                code, value = self.features([p for _, p in part])
                score = (self.weights[code] * value).sum(1) + self.bias
                for (w, _), s in zip(part, score.tolist(), strict=True):
                    best[w] = max(best[w], s)
        return best

    def fill(self, words: set[str]) -> None:
        """Puts the scores of all of `words`, MAX_WORDS at most, into the table. A full table becomes the older one, from
        which words still in use come back."""
        if len(self.known) + len(words) > MAX_WORDS:
            self.known, self.older = {}, self.known
        missing = set()
        for w in words:
            if w not in self.known:
                score = self.older.get(w)
                if score is None:
                    missing.add(w)
                else:
                    self.known[w] = score
        self.known.update(self.rate(missing))

    def features_of(self, bags: list[Collection[str]]) -> np.ndarray:
        """Per text's words: its three highest word scores, and how many words score above 0 (root of the share)."""
        top, above, size = np.full((len(bags), 3), -1.0), np.zeros(len(bags)), np.zeros(len(bags))
        for part in portions(bags):
            self.fill(set().union(*(words for _, words in part)))
            for i, words in part:
                scores = np.fromiter(map(self.known.__getitem__, words), float, len(words))
                best = np.concatenate((top[i], scores))
                top[i] = np.sort(np.partition(best, len(best) - 3)[-3:])[::-1]
                above[i] += np.count_nonzero(scores > 0)
                size[i] += len(words)
        return np.column_stack((np.clip(top, -1, 2), np.sqrt(above / (size + 10))))


def nystrom_svm(positive: list[str], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM on the Nyström map; returned as weights on the hashed subsequences, and a bias."""
    feature, size = Subsequences(), 1 << HASH_BITS
    by = lambda words: [list(g) for _, g in itertools.groupby(sorted(words, key=lambda w: (len(w), w)), len)]
    marks = [w for g in by(landmarks) for w in g]
    rows = [(code, value) for g in by(landmarks) for code, value in zip(*feature(g), strict=True)]
    used = np.unique(np.concatenate([code for code, _ in rows]))
    small, index = np.zeros((len(used) + 1, len(marks)), np.float32), np.full(size, len(used), np.int64)
    index[used] = np.arange(len(used))
    for j, (code, value) in enumerate(rows):
        np.add.at(small[:, j], index[code], value)

    def kernel(words: list[str], to_map: np.ndarray | None = None) -> np.ndarray:
        """Products with the landmarks, or their image under to_map and a one."""
        out, at = np.ones((len(words), len(marks) if to_map is None else to_map.shape[1] + 1), np.float32), 0
        for g in by(words):
            for k in range(0, len(g), 128):
                code, value = feature(g[k : k + 128])
                part = np.zeros((len(code), len(used) + 1), np.float32)
                np.add.at(part, (np.arange(len(code))[:, None], index[code]), value)
                part = part @ small
                out[at : at + len(part), : out.shape[1] - (to_map is not None)] = part if to_map is None else part @ to_map
                at += len(part)
        return out

    value, vector = np.linalg.eigh(kernel(marks).astype(float))
    keep = value > 1e-4 * value.max()
    to_map = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    x = np.vstack([kernel(positive, to_map), kernel(negative, to_map)])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    cost = np.repeat([0.3 * max(1.0, len(negative) / max(1, len(positive))), 1.0], [len(positive), len(negative)])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-1)
    ridge[-1] = 1e-6
    for _ in range(40):  # Newton steps on the active set
        on = np.flatnonzero(y * (x @ w) < 1)
        left, right = np.diag(ridge), np.zeros(x.shape[1])
        for k in range(0, len(on), 4096):
            part = x[on[k : k + 4096]].astype(float)
            a = part * cost[on[k : k + 4096], None]
            left, right = left + a.T @ part, right + a.T @ y[on[k : k + 4096]]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    weights = np.zeros(size, np.float32)
    weights[used] = small[:-1] @ (to_map @ w[:-1])
    return weights, float(w[-1])


class Model:
    def __init__(self, texts: Iterable[str], toxic: list[int]):
        pool: dict[str, str] = {}
        found = [[pool.setdefault(w, w) for w in words_of(t)] for t in texts]  # of the texts only their words stay
        bags = [{pool.setdefault(p, p) for w in words for p in pieces(w)} for words in found]
        counts = [Counter(), Counter()]
        for bag, label in zip(bags, toxic, strict=True):
            counts[label].update(bag)
        n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
        lift = {w: (c / n[1] + 0.2 / n[1]) / ((counts[0][w] + 0.2) / n[0]) for w, c in counts[1].items()}
        ranked = sorted(lift, key=lambda w: (-(lift[w] ** 0.5) * counts[1][w], w))
        seeds = [w for w in ranked if lift[w] >= 8 and counts[1][w] * np.log(lift[w]) >= EVIDENCE][:TRAIN_WORDS] or ranked[:20]
        common = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if lift.get(w, 0) < 2]
        rng = np.random.default_rng(5)
        negative = [common[i] for i in rng.permutation(len(common))[:TRAIN_WORDS]]
        marks = list(dict.fromkeys(seeds[: LANDMARKS // 2] + common[: LANDMARKS // 2])) or ["none"]
        positive = seeds
        self.weights, self.bias = np.zeros(1 << HASH_BITS, np.float32), -1.0
        for _ in range(3 if positive and negative else 0):
            self.weights, self.bias = nystrom_svm(positive, negative, marks)
            score = WordScores(self.weights, self.bias)
            known = score.rate(set().union(*bags))
            # the words of clean texts that look most toxic join the negatives; each toxic text names its witnesses
            hard = sorted(common, key=lambda w: (-known.get(w, -1), w))[: TRAIN_WORDS // 3]
            negative = list(dict.fromkeys(hard + negative))[: 2 * TRAIN_WORDS]
            witness = {w for bag, label in zip(bags, toxic, strict=True) if label for w in sorted(bag, key=lambda w: (-known.get(w, -1), w))[:1] if lift[w] >= 2}
            positive = list(dict.fromkeys(seeds + sorted(witness)))[:TRAIN_WORDS]
        x = WordScores(self.weights, self.bias).features_of(found)
        x, y = np.hstack([x, np.ones((len(x), 1))]), np.array(toxic, float)
        self.logistic = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * self.logistic)
            self.logistic += np.clip(step, -5, 5)


def trained(rows: Iterable[dict]) -> Model | None:
    toxic: list[int] = []

    def texts() -> Iterator[str]:
        for r in rows:
            toxic.append(r["toxic"])
            yield r["text"]

    model_of = Model(texts(), toxic)
    return model_of if set(toxic) == {0, 1} else None


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """labels: (doc_id, toxic). The TRAIN_ROWS labelled rows of each class with the least hash of doc_id are read, one text for
    each: of repeated ids the one with the least hash. Null ids and labels other than 0 and 1 are left out, repeated labels
    count once, a null text is empty; whole texts are read. None without rows of both classes. Fitted in one task."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("_h")).distinct()
    some = marked.withColumn("_r", F.row_number().over(Window.partitionBy("toxic", F.pmod("_h", F.lit(64))).orderBy("_h"))).where(F.col("_r") <= 2 * TRAIN_ROWS // 64)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("toxic").orderBy("_h"))).where(F.col("_r") <= TRAIN_ROWS).select("doc_id", "toxic")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    model = fit_in_task(rows.repartition(1).sortWithinPartitions("doc_id", "toxic"), trained, Model)
    if model:  # the sample may hold the classes in other shares than all labels do: scores follow those of the labels
        shares = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
        model.logistic[-1] += np.log(shares[1] / shares[0]) - np.log(min(shares[1], TRAIN_ROWS) / min(shares[0], TRAIN_ROWS))
    return model


SCHEMA = "score double"


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep` and `score` for each row; a kept column named score gives way. Null text is scored as empty; with
    nothing learned all score 0. Rows are handled alone, so repeated rows and ties score alike, an empty table gives no rows,
    and a text of any length is read as a whole, in portions of MAX_WORDS words."""
    rows = docs.select(*without(keep, SCHEMA), F.coalesce("text", F.lit("")).alias("_text"))
    out = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(SCHEMA).fields)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        model = shared()
        words = WordScores(model.weights, model.bias) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = words.features_of([words_of(t) for t in part.column(part.num_columns - 1).to_pylist()]) if words else np.zeros((part.num_rows, 4))
                z = np.hstack([x, np.ones((len(x), 1))]) @ (model.logistic if model else np.zeros(5))
                value = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(value, pa.float64())], names=out.names)

    return rows.mapInArrow(run, out)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    out = score(docs, fit(docs, labels), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
