"""Fill-in-middle: texts are cut into prefix, middle and suffix at units, and rearranged so that the middle comes last.

A batch of texts is handled by whole columns of pyarrow.compute: gaps and words are split into list arrays, flattened with their texts' indexes and
joined to units; a unit's ordinal within its text gives its role; each role's units are filtered, put back into lists and joined to pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import make_room, table, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are rearranged, and of these the share with the suffix first.
RATE, SPM_SHARE = 50, 80
#: Bytes of text handled at once (one text at least).
PORTION = 8 << 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def units_of(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """All texts' units, the index of the text each is from, and the number of units by text.

    A unit is a word with the white space before it; white space at the end is a unit of its own.
    """
    words = pc.split_pattern_regex(text, pattern=r"[\x20\x09-\x0D]+")
    gaps = pc.split_pattern_regex(text, pattern=r"[^\x20\x09-\x0D]+")
    word, of_word = pc.list_flatten(words), pc.list_parent_indices(words)
    full = pc.greater(pc.binary_length(word), 0)
    word, of_word = word.filter(full), of_word.filter(full)
    gap, row = pc.list_flatten(gaps), pc.list_parent_indices(gaps)
    # the i-th gap of a text stands before its i-th word, the last one behind all words
    n_words = np.bincount(of_word.to_numpy(), minlength=len(text))
    ordinal = ordinals(row, len(text))
    at = (np.cumsum(n_words) - n_words)[row.to_numpy()] + ordinal
    follows = pc.take(word, pa.array(at, mask=ordinal >= n_words[row.to_numpy()]))
    unit = pc.binary_join_element_wise(gap, pc.fill_null(follows, ""), "")
    full = pc.greater(pc.binary_length(unit), 0)
    unit, row = unit.filter(full), row.filter(full)
    return unit, row, np.bincount(row.to_numpy(), minlength=len(text))


def ordinals(row: pa.Array, n: int) -> np.ndarray:
    """Place of each item within its list, from the lists' indexes in order."""
    of = row.to_numpy()
    count = np.bincount(of, minlength=n)
    return np.arange(len(of)) - (np.cumsum(count) - count)[of]


def joined(unit: pa.Array, row: pa.Array, role: np.ndarray, n: int) -> pa.Array:
    """The units of one role put together by text; empty where a text has none."""
    own = row.filter(pa.array(role)).to_numpy()
    offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), unit.filter(pa.array(role)))
    return pc.binary_join(lists, "")


def rearranged(text: pa.Array, form: pa.Array, h1: np.ndarray, h2: np.ndarray) -> list[pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of non-null texts whose form is chosen."""
    unit, row, n = units_of(text)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high, of, ordinal = np.minimum(a, b), np.maximum(a, b), row.to_numpy(), ordinals(row, len(text))
    before, after = ordinal < low[of], ordinal >= high[of]
    prefix, middle, suffix = (joined(unit, row, role, len(text)) for role in (before, ~before & ~after, after))
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "psm"), psm, spm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output]


def portions(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (start, length) of texts that hold PORTION bytes together, or one text each."""
    size, at = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
    while at < len(text):
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, side="right"))
        yield at, max(upto, at + 1) - at
        at = max(upto, at + 1)


def infill(docs: DataFrame, keep: list[str], seed: int = 42, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Columns `keep`, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Cuts and forms follow from the seed and doc_id alone, so reruns and repeated rows agree; a null doc_id counts as an empty one. Null text is
    empty; empty texts and those that hold a mark stay plain. Texts of any length are cut as a whole; an empty table gives no rows; kept columns with a
    result's name give way.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm")
    rows = docs.select(*without(keep, SCHEMA), text.alias("_text"), form.alias("_form"), h[0].alias("_h1"), h[1].alias("_h2"))
    out = StructType(rows.drop("_text", "_form", "_h1", "_h2").schema.fields + StructType.fromDDL(SCHEMA).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for at, length in portions(batch.column("_text")):
                part = batch.slice(at, length)
                h1, h2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2"))
                made = rearranged(part.column("_text"), part.column("_form"), h1, h2)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 4)), *made], names=out.names)

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text again. No piece holds a mark, so the first mark of each kind is the one that was set."""
    n = len(PREFIX)

    def between(first: str, then: str) -> Column:
        start, end = F.locate(first, output), F.locate(then, output)
        return F.substring(output, start + n, end - start - n)

    middle = F.substring(output, F.locate(MIDDLE, output) + n, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill(table(spark, sf_dir, "documents"), ["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
