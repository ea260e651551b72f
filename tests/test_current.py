"""The current table, admission with release, deadlines, bounded dedupe, sweeps and frontiers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lineproof.operators import facts as A
from lineproof.sources.current import CurrentTable
from lineproof.sources.scratch import stored
from lineproof.streaming import notices as S

ROWS = "doc_id long, version long, text string"


def held(table, number=None):
    return {r.doc_id: (r.version, r.text) for r in table.read(number).collect()}


def test_merges_commit_or_leave_no_trace(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], ROWS).schema
    table = CurrentTable(spark, f"file://{tmp_path}/t", schema, "doc_id", ["version"], buckets=4)
    assert held(table) == {} and table.commits() == []
    want, batches = {}, [[(random.Random(i).randrange(12), 10 * i + j, f"t{i}{j}") for j in range(6)] for i in range(5)]
    history = []
    for i, rows in enumerate(batches):
        assert table.merge(spark.createDataFrame(rows, ROWS), i)
        for d, v, t in rows:
            want[d] = max(want.get(d, (v, t)), (v, t))
        assert held(table) == want
        history.append(dict(want))
    # A replayed merge changes nothing; rows older than what stands lose.
    assert not table.merge(spark.createDataFrame([(0, 999, "replayed")], ROWS), 4) and held(table) == want
    assert table.merge(spark.createDataFrame([(batches[0][0][0], -1, "old")], ROWS), 5) and held(table) == want
    # A merge that stops between its rows and its commit is not seen, and is done again.
    with monkeypatch.context() as m:
        m.setattr(CurrentTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(spark.createDataFrame([(1, 5000, "half")], ROWS), 6)
    assert held(table) == want and table.commits()[-1] == 5
    assert table.merge(spark.createDataFrame([(1, 5000, "whole")], ROWS), 6) and held(table)[1] == (5000, "whole")
    assert held(table, 4) == history[4]
    assert table.merge(spark.createDataFrame([], ROWS), 7) and table.read().count() == len(held(table))
    assert table.clear(commits=1) > 0 and table.commits() == [7] and held(table)[1] == (5000, "whole")
    assert len(table.read().inputFiles()) <= 4


def replay(events, most, span, active, lease):
    starts, leases, out = {}, {}, {}
    for at, event, key, release in sorted(events):
        live, on = [s for s in starts.get(key, []) if s > at - span], [x for x in leases.get(key, []) if x > at - lease]
        if release:
            on = on[1:]
        elif len(on) >= active:
            out[event] = (False, 5)
        elif len(live) >= most:
            out[event] = (False, max(1, -int(-(live[0] + span - at) // 1)))
        else:
            out[event] = (True, 0)
            live, on = [*live, at], [*on, at]
        starts[key], leases[key] = live, on
    return out


def test_admission_with_release(spark, tmp_path):
    """Shuffled over micro-batches and restarted half way; then closed."""
    rng = random.Random(3)
    events = [(float(rng.randrange(0, 1500)) + i / 1000, i, rng.randrange(3), rng.random() < 0.4) for i in range(240)]
    # Within ten minutes of event time the order is free: each file holds five minutes, shuffled.
    path, schema, found = str(tmp_path / "in"), "at double, event_id long, user_id long, release boolean", None
    for half in range(2):
        for slot in range(3 * half - 1, 3 * half + 2):
            part = [e for e in events if int(e[0] // 300) == slot]
            rng.shuffle(part)
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = S.arriving(spark, path, files_each=1).withColumn("ts", F.timestamp_seconds("at"))
        found = S.admitted_with_release(stream, "user_id", 4, 60, 2, 120, "10 minutes", base=f"file://{tmp_path}/run", last=half == 1).collect()
    assert {r.event_id: (r.admitted, r.retry_after) for r in found} == replay(events, 4, 60, 2, 120)
    assert len(found) == sum(not e[3] for e in events) and len({r.admitted for r in found}) == 2


def test_fallback_leaves_the_stream_at_its_deadline(spark, tmp_path):
    """Each file moves the watermark; a request is settled in the first micro-batch after its deadline, not at the end."""
    asked = [[(1, 0), (2, 5)], [(3, 200)], [(4, 400)], [(5, 600)]]
    told = [[(1, 10), (1, 12)], [(2, 60), (3, 230)], [(4, 401)], [(9, 600)]]
    for i in range(4):
        for name, rows in (("asked", asked[i]), ("told", told[i])):
            spark.createDataFrame([(i, 1000.0 + t) for i, t in rows], "request_id long, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, at: S.arriving(spark, str(tmp_path / name), files_each=1).select("request_id", F.timestamp_seconds("at").alias(at))
    found = {r.request_id: r for r in S.correlated(read("asked", "asked_at"), read("told", "told_at"), 45, "20 seconds", base=f"file://{tmp_path}/run").collect()}
    assert {k: (r.n_responses, r.state) for k, r in found.items()} == {1: (2, "repeated"), 2: (0, "fallback"), 3: (1, "accepted"), 4: (1, "accepted"), 5: (0, "fallback")}
    assert found[1].batch == found[2].batch < found[3].batch < found[4].batch < found[5].batch


def state_rows(spark, run):
    """Rows in the state store at the end of each micro-batch."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    seen = []

    class Listen(StreamingQueryListener):
        onQueryStarted = onQueryTerminated = onQueryIdle = lambda self, e: None

        def onQueryProgress(self, event):
            seen.extend(op.numRowsTotal for op in event.progress.stateOperators)

    listener = Listen()
    spark.streams.addListener(listener)
    try:
        found = run().collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return found, seen


@pytest.mark.parametrize("each", [True, False])
def test_dedupe_forgets(spark, tmp_path, each):
    """Copies in the span go; later ones come again; the state does not grow with the keys seen."""
    for i in range(6):
        rows = [(f"k{i}-{j % 40}", 3600.0 * i + j) for j in range(80)] + [("again", 3600.0 * i + 90)]
        spark.createDataFrame(rows, "chunk string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.arriving(spark, str(tmp_path / "in"), files_each=1).select("chunk", F.timestamp_seconds("at").alias("ts"))
    run = (lambda: S.requested_each(stream, "chunk", "ts", "10 minutes")) if each else (lambda: S.requested_within(stream, "chunk", "ts"))
    found, seen = state_rows(spark, run)
    times = sum(r.chunk == "again" for r in found)
    assert sorted(r.chunk for r in found) == sorted([f"k{i}-{j}" for i in range(6) for j in range(40)] + ["again"] * times)
    # A key within the watermark is forgotten once that has passed, which the next micro-batch tells.
    assert times == 6 if each else 2 <= times <= 6
    assert max(seen) < 41 * 4


def test_active_requests(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), a, a + rng.choice([0, -5, rng.randrange(1, 400)])) for i, a in enumerate(rng.randrange(0, 3000) for _ in range(300))]
    df = spark.createDataFrame([(i, k, a * 1_000_000, b * 1_000_000) for i, k, a, b in rows], "event_id long, user_id long, started long, ended long")
    want = {i: sum(1 for j, m, c, d in rows if m == k and (j == i or c <= a < d)) for i, k, a, _ in rows}
    for width in (50, 86_400):
        got = {r.event_id: (r.n_active, r.over_active) for r in A.active_requests(df, "user_id", 2, width).collect()}
        assert got == {i: (n, n > 2) for i, n in want.items()}
    assert A.active_requests(df.filter("false"), "user_id").count() == 0


def test_contamination_follows_the_frontier(spark):
    """A chain of 24 items, a hub that many items cite, and an island: each round asks for what is new."""
    cites = [(i, i) for i in range(24)] + [(i, i + 1) for i in range(24)] + [(100 + i, 24) for i in range(50)] + [(100 + i, 200 + i) for i in range(50)] + [(900, 900), (901, 900)]
    sizes = []

    def counted(df):
        found = stored(df)
        sizes.append(found.count())
        return found

    df = spark.createDataFrame(cites, "item long, line long")
    got = {r.line for r in A.contaminated(df, spark.createDataFrame([(0,)], "line long"), counted).collect()}
    assert got == set(range(25)) | set(range(200, 250))
    fresh = [n for n in sizes if n < 60]
    assert fresh.count(1) > 40 and sizes[-1] == 0
    assert A.contaminated(df, df.select("line").filter("false"), stored).count() == 0
