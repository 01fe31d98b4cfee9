"""The last results of a session, begun anew when the request changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopmill.streaming.live import keep_until

#: Fixed value.
KEPT = 8


def history(results: DataFrame) -> DataFrame:
    """(key, place, seq, error_m): newest first, of (key, ts, seq, request, error_m), since the session's request last changed."""
    order = Window.partitionBy("key").orderBy("ts", "seq")
    changed = (F.row_number().over(order) > 1) & ~F.col("request").eqNullSafe(F.lag("request").over(order))
    runs = results.withColumn("_c", changed.cast("int")).withColumn("_run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    newest = Window.partitionBy("key").orderBy(F.desc("_run"), F.desc("ts"), F.desc("seq"))
    last = F.max("_run").over(Window.partitionBy("key"))
    ranked = runs.withColumns({"place": F.row_number().over(newest), "_last": last})
    return ranked.where((F.col("_run") == F.col("_last")) & (F.col("place") <= KEPT)).select("key", "place", "seq", "error_m")


def history_stream(results: DataFrame, idle_s: float | None = None) -> DataFrame:
    """(key, place, seq, error_m) of each session after a trigger that had results for it. At most eight results are kept; with
    idle_s none once the watermark, which results must then have, is so many seconds past the session's last."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        request, seqs, errors = state.get if state.exists else (None, [], [])
        seqs, errors = list(seqs), list(errors)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for row in rows.itertuples():
            if seqs and row.request != request:
                seqs, errors = [], []
            request, seqs, errors = row.request, [row.seq, *seqs][:KEPT], [row.error_m, *errors][:KEPT]
        state.update((request, seqs, errors))
        keep_until(state, rows["ts"], idle_s)
        yield pd.DataFrame({"key": [key[0]] * len(seqs), "place": range(1, len(seqs) + 1), "seq": seqs, "error_m": errors})

    return results.groupBy("key").applyInPandasWithState(update, "key long, place int, seq long, error_m double", "request string, seqs array<long>, errors array<double>", "update", "NoTimeout" if idle_s is None else "EventTimeTimeout")
