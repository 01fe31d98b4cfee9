"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by permuterm rotations.

Every word gets a terminator and is written once for each of its rotations. If two words differ in one code point, the rotations that end with it
share all that stands before it: the rotation less its end is their common prefix when the end was replaced, and it is the other word's whole
rotation when the end was inserted. So the sorted rotations are scanned once with a stack of open prefixes, and each prefix range gives its
neighbours. A range holds at most one word for each letter that can follow, so no group grows with the table.

Words of more than LONG code points, whose rotations would fill the square of their length, meet by the half that the edit leaves alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_room, materialize, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: The terminator sorts before all letters of RUN.
END = "$"
#: Shortest word and least occurrences; one of DELETE_EVERY occurrences (by hash) loses a code point; a form occurs RATIO times as often.
LEAST_CHARS, LEAST_N, DELETE_EVERY, RATIO = 5, 3, 97, 2
LONG = 128
NEAR = "word string, n_near long, best_n long, best string"


def spellings(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct spellings of at least LEAST_CHARS code points that occur LEAST_N times or more."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    # shorter runs can't become words
    runs = runs.where(F.length("run") >= LEAST_CHARS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def rotations(word: Column) -> Column:
    marked = F.concat(word, F.lit(END))
    size = F.length(marked)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(marked, i, size), F.substring(marked, F.lit(1), i - 1)))


def word_of(rotation: str) -> str:
    head, _, tail = rotation.partition(END)
    return tail + head


def of_range(prefix: str, whole: int, ends: list[tuple[str, int]], out: list[list]) -> None:
    """Adds what each word of one prefix range has as neighbours there: (word, their number, most occurrences, the least word of these).

    whole: occurrences of the word that is the prefix itself (0: none); ends: the words that go on with one more letter, by letter. A letter doubled by an insertion
    can be taken off at either place; only the first place counts, so each pair counts once.
    """
    found = [(n, word_of(prefix + c), c) for c, n in ends]
    own = word_of(prefix) if whole else None
    best = sorted(found, key=lambda x: (-x[0], x[1]))[:2]
    inserted = [x for x in found if x[2] != prefix[-1]] if whole else []
    for n, word, c in found:
        first = own is not None and c != prefix[-1]
        near = len(found) - 1 + first
        if near:
            options = [(-m, w) for m, w, _ in best if w != word] + ([(-whole, own)] if first else [])
            m, w = min(options)
            add(out, word, near, -m, w)
    if inserted:
        m, w = min((-n, word) for n, word, _ in inserted)
        add(out, own, len(inserted), -m, w)


def add(out: list[list], *row) -> None:
    for column, value in zip(out, row, strict=True):
        column.append(value)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations to neighbours. stack: open ranges as [prefix, occurrences of the prefix itself, words that go on]."""
    make_room()
    names = ["word", "n_near", "best_n", "best"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    stack: list[list] = []
    out: list[list] = [[], [], [], []]

    def close() -> None:
        prefix, whole, ends = stack.pop()
        if len(ends) + (whole > 0) > 1:
            of_range(prefix, whole, ends, out)

    for batch in batches:
        for rotation, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while stack and not rotation.startswith(stack[-1][0]):
                close()
            if rotation[-1] != END:
                if not stack or stack[-1][0] != rotation[:-1]:
                    stack.append([rotation[:-1], 0, []])
                stack[-1][2].append((rotation[-1], n))
            stack.append([rotation, n, []])
        if len(out[0]) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            out[:] = [[], [], [], []]
    while stack:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :]


def near_long(vocabulary: DataFrame) -> DataFrame:
    """NEAR rows of the pairs with a word of more than LONG code points: both share the first or the last half of the shorter."""
    size = F.length("word")
    # a word meets those of its own length, of one less and of one more; the shorter's length names the meeting
    half = F.floor(F.col("least") / 2).cast("int")
    keyed = vocabulary.where(size >= LONG).select("word", "n", F.explode(F.array(size, size - 1)).alias("least"))
    head = F.concat(F.lit("<"), F.substring("word", F.lit(1), half))
    tail = F.concat(F.lit(">"), F.substring("word", size - (F.col("least") - half) + 1, size))
    keyed = keyed.select("word", "n", "least", F.explode(F.array(F.sha2(head.cast("binary"), 256), F.sha2(tail.cast("binary"), 256))).alias("key"))
    a, b = keyed.select("key", "least", F.col("word").alias("a"), F.col("n").alias("a_n")), keyed.select("key", "least", F.col("word").alias("b"), F.col("n").alias("b_n"))
    longest = F.greatest(F.length("a"), F.length("b"))
    met = a.join(b, ["key", "least"]).where((F.col("a") < F.col("b")) & (longest > LONG) & (F.least(F.length("a"), F.length("b")) == F.col("least"))).select("a", "a_n", "b", "b_n")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[np.array([one_edit(x, y) for x, y in zip(pdf["a"], pdf["b"], strict=True)], bool)]

    pairs = met.mapInPandas(check, "a string, a_n long, b string, b_n long").distinct()
    one = F.lit(1).cast("long").alias("n_near")
    return pairs.select(F.col("a").alias("word"), one, F.col("b_n").alias("best_n"), F.col("b").alias("best")).union(pairs.select("b", one, "a_n", "a"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words; best is the one of most occurrences, ties to the least word."""
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = vocabulary.where(F.length("word") <= LONG).select(F.explode(rotations(F.col("word"))).alias("rotation"), "n")
    # a range's prefix has LEAST_CHARS code points at least, so ranges stay whole
    turned = turned.repartition(parts, F.substring("rotation", 1, LEAST_CHARS)).sortWithinPartitions("rotation")
    found = turned.mapInArrow(scan, NEAR).unionByName(near_long(vocabulary))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word.

    A word's form is its best near word if that occurs RATIO times as often, else null; its root is the last of its forms' chain. Null texts have no
    words, a null doc_id counts as an empty one, repeated rows count each, texts and words of any length are read whole, ties go to the least word; an empty
    table gives no rows; other columns are ignored.
    """
    vocabulary = materialize(spellings(docs), "words")
    near = neighbours(vocabulary)
    close = F.col("best_n") >= RATIO * F.col("n")
    own = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(close, F.col("best")).alias("form"), F.when(close, F.col("best_n")).alias("form_n"))
    own = materialize(own, "word-forms")
    return own.join(roots(own.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each round doubles the steps that a pointer spans; occurrences at least double with each step, so there
    are a few rounds whatever the table."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        then = now.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        new = now.join(then, now["root"] == then["_w"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        new = materialize(new, "word-roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
