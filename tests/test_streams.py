"""Streams with expiring state, stopped and started again from their checkpoint between files."""

from datetime import datetime, timedelta

from loopmill.streaming import history, live

START = datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, seq long, request string, error_m double"
#: Files in turn: (key, minute, seq, request, error).
FILES = [
    [(1, 0, 1, "a", 300.0), (2, 0, 2, "a", 60.0)],
    [(1, 1, 3, "a", 900.0), (2, 1, 4, "a", 90.0), (1, 2, 5, "a", 40.0)],
    [(3, 60, 6, "b", 10.0)],
    [(3, 61, 7, "b", 15.0)],
    [(1, 62, 8, "a", 2000.0), (2, 62, 9, "c", 500.0)],
]


def runs(spark, tmp_path, make):
    """The rows that each file's run put out, by batch; every run is a new query on the same checkpoint."""
    (tmp_path / "in").mkdir()
    out = []
    for i, rows in enumerate(FILES):
        df = spark.createDataFrame([(k, START + timedelta(minutes=m), s, r, e) for k, m, s, r, e in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        stream = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute"))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda b, _, got=got: got.extend(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        out.append(got)
    return out


def test_best_route_stream_goes_on_after_restarts_and_forgets(spark, tmp_path):
    first, second, _, _, last = runs(spark, tmp_path, lambda s: live.best_route_stream(s, 600))
    assert {r.key: r.error_m for r in first} == {1: 300.0, 2: 60.0}
    # kept over the restart: 900 is much worse than 300 and isn't shown, 90 has lost the tolerance
    assert {r.key: r.error_m for r in second} == {1: 40.0, 2: 60.0}
    # an hour later nothing is known any more
    assert {r.key: r.error_m for r in last} == {1: 2000.0, 2: 500.0}


def test_history_stream_goes_on_after_restarts_and_forgets(spark, tmp_path):
    first, second, _, _, last = runs(spark, tmp_path, lambda s: history.history_stream(s, 600))
    of = lambda rows, key: [r.seq for r in sorted(rows, key=lambda r: r.place) if r.key == key]
    assert of(first, 1) == [1] and of(second, 1) == [5, 3, 1] and of(second, 2) == [4, 2]
    assert of(last, 1) == [8] and of(last, 2) == [9]
