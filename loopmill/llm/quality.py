"""Host-level quality rules: rule failures per host, rates shrunk by an empirical beta prior, verdicts joined back.

Only DataFrame functions. A text's arrays stay inside its row, so no text is ever shuffled; the shuffles
carry one narrow row per document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, let, materialize, table, words

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
#: A document fails the symbol rule above so many symbols a hundred word characters.
SYMBOL_PERCENT = 10
#: ... and the line rule if more than so many of a hundred lines with words repeat an earlier one.
LINE_PERCENT = 30
#: A host is rejected on a rule if its shrunk failure rate less Z standard deviations is above HOST_TIMES the rate of all
#: documents, and above HOST_LEAST (rare rules) in any case; above HOST_MOST it always is.
HOST_TIMES, HOST_LEAST, HOST_MOST = 3.0, 0.15, 0.5
Z = 1.645
RULES = ("short", "repeats", "symbols", "lines")


def repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the array w (all occurrences).

    A window is known by the 64-bit hash of its words. Only texts in which some hash recurs are sorted;
    then the starts of recurring windows are put in order and each adds the words the next one doesn't.
    """

    def covered(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            n = F.size(s)
            again = lambda i: ((i > 0) & (F.get(s, i - 1)["h"] == F.get(s, i)["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == F.get(s, i)["h"]))
            starts = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(again(i), F.lit(False))), lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")))["n"])

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, from_sorted)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) > WINDOW, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_f`: struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), longs."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumns({"_w": of_words, "_l": of_lines, "_s": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")}).withColumn("_f", F.struct("_w.n_words", "_w.word_chars", F.col("_s").alias("n_symbols"), "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines")).drop("_w", "_l", "_s")


def host_verdicts(base: DataFrame) -> DataFrame:
    """(host, host_rejected, host_rate_<rule>) from documents with host and a boolean column per rule.

    Per rule the prior is Beta(a, b) fitted by moments to the hosts' rates, weighted by their documents;
    the prior's two numbers are the only values that reach the driver.
    """
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(r).alias(r) for r in RULES))
    rate = {r: F.col(r) / F.col("n") for r in RULES}
    m = {r: F.sum(r) / F.sum("n") for r in RULES}
    moments = hosts.agg(*(m[r].alias(f"m_{r}") for r in RULES), *((F.sum(F.col("n") * rate[r] * rate[r]) / F.sum("n") - m[r] * m[r]).alias(f"v_{r}") for r in RULES)).first()
    out, bad = hosts, F.lit(False)
    for r in RULES:
        mean, var = moments[f"m_{r}"] or 0.0, max(moments[f"v_{r}"] or 0.0, 1e-6)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        strength = min(max(mean * (1 - mean) / var - 1, 2.0), 1000.0)
        total = F.col("n") + strength
        p = (F.col(r) + mean * strength) / total
        out = out.withColumn(f"host_rate_{r}", p)
        bad = bad | (p - Z * F.sqrt(p * (1 - p) / (total + 1)) > min(HOST_MOST, max(HOST_LEAST, HOST_TIMES * mean)))
    return out.withColumn("host_rejected", bad).select("host", "host_rejected", *(f"host_rate_{r}" for r in RULES))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: doc_id, the features, base_failed, host_rejected, kept and the host's rates.

    Null text counts as empty; a null host is a host of its own; other columns are ignored, whatever their names; an empty
    table gives no rows; repeated rows are judged one by one. Texts of any length are read whole, inside their row. A rate equal to
    its limit doesn't reject, so ties are kept.
    """
    f = base_features(docs.select("doc_id", F.col(host).alias("host"), "text")).select("doc_id", "host", "_f.*")
    base = f.withColumns({
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    })
    base = materialize(base, "quality")
    out = join_small(base, host_verdicts(base), "host")
    failed = F.col("short") | F.col("repeats")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_rejected"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
