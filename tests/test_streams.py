"""Streams over several micro-batches against their batch form and brute force."""

from pyspark.sql import functions as F

from lineproof.streaming import notices as S


def written(spark, rows, schema, path, files=3):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return S.arriving(spark, path, files_each=1)


def test_admission_over_micro_batches(spark, tmp_path):
    rows = [(k, 100 * k + i, 10.0 * i) for k in (1, 2) for i in range(20)]
    for part in (rows[:10] + rows[20:30], rows[10:20] + rows[30:]):
        spark.createDataFrame(part, "user_id long, event_id long, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.arriving(spark, str(tmp_path / "in"), files_each=1)
        found = S.admitted(stream.withColumn("ts", F.timestamp_seconds("at")), "user_id", 3, 60, base=f"file://{tmp_path}/run").collect()
    want, starts = {}, {1: [], 2: []}
    for k, e, at in rows:
        live = [s for s in starts[k] if s > at - 60]
        want[e] = (len(live) < 3, 0.0 if len(live) < 3 else live[0] + 60 - at)
        starts[k] += [at] * want[e][0]
    assert {r.event_id: (r.admitted, r.retry_after) for r in found} == want


def test_snapshots_requests_and_status(spark, tmp_path):
    rows = [(i % 4, i, f"line {i % 5}\nline {i % 3}") for i in range(24)]
    stream = written(spark, rows, "doc_id long, version long, text string", str(tmp_path / "docs"))
    newest = {r.doc_id: r.text for r in S.latest_snapshots(stream, "doc_id", ["version"], ["text"]).collect()}
    assert newest == {k: t for k, _, t in rows}
    assert S.requested_once(stream).count() == 5
    landed = S.landed(stream.select("doc_id", F.col("version").alias("stage")))
    assert landed.count() == 24 and landed.select("batch").distinct().count() >= 3
    status = S.current_status([stream.select("doc_id", F.col("version").alias("stage"))], "doc_id").collect()
    assert {tuple(r) for r in status} == {(k, 20 + k) for k in range(4)}


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert S.requested_once(S.arriving(spark, str(tmp_path / "none"))).count() == 0


def test_waiting_events_reach_the_state_in_one_call_a_frame():
    """One call an event before."""
    from unittest.mock import MagicMock

    import pandas as pd

    from lineproof.streaming.notices import Slots

    slots, calls = Slots(6, 60, 2, 600), MagicMock()
    slots.handle, slots.waiting, slots.slots = MagicMock(), calls, MagicMock()
    list(slots.handleInputRows((1,), iter([pd.DataFrame({"at": [3, 1, 2], "event_id": [1, 2, 3], "release": [False, True, False]})]), None))
    assert [c[0] for c in calls.method_calls] == ["appendList"] and calls.appendList.call_args.args[0] == [(3, 1, False), (1, 2, True), (2, 3, False)]
