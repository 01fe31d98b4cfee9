"""Streams of results and keystrokes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_M = 0.05 * 1609.344
DEBOUNCE = "300 milliseconds"


def debounced(keystrokes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(key, started, value): the last value of each burst of (key, ts, seq, value). Batch or stream (set a watermark)."""
    burst = F.session_window("ts", gap)
    return keystrokes.groupBy("key", burst.alias("burst")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value")).select("key", F.col("burst.start").alias("started"), "value")


def best_route_stream(results: DataFrame, idle_s: float | None = None) -> DataFrame:
    """(key, error_m) after each trigger for a stream of (key, ts, seq, error_m): a result replaces the shown one unless it
    is meaningfully worse. The state is one number a key; with idle_s it goes once the watermark (which results must then have)
    is so many seconds past the key's last result, and the next result is shown whatever it is."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shown, rows = state.get[0] if state.exists else None, pd.concat(list(batches)).sort_values(["ts", "seq"])
        for x in rows["error_m"]:
            if shown is None or not ((shown <= TOLERANCE_M < x) or x - shown > 150):
                shown = x
        state.update((float(shown),))
        keep_until(state, rows["ts"], idle_s)
        yield pd.DataFrame({"key": [key[0]], "error_m": [float(shown)]})

    return results.groupBy("key").applyInPandasWithState(update, "key long, error_m double", "error_m double", "update", "NoTimeout" if idle_s is None else "EventTimeTimeout")


def keep_until(state, ts: pd.Series, idle_s: float | None) -> None:
    """The state's end: idle_s seconds after the last of ts, and after the watermark in any case."""
    if idle_s is not None:
        last = int(ts.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + int(idle_s * 1000), state.getCurrentWatermarkMs() + 1))
