"""Structured Streaming over arriving notices: snapshots, admission, correlation, distinct requests, current status.

Sinks are Parquet tables with one folder a micro-batch, overwritten when the batch is replayed, so a query that restarts
from its checkpoint leaves the same rows. Tables and checkpoints stand in the folder that the session names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lineproof.operators import lines as L
from lineproof.sources.current import BUCKETS, CurrentTable
from lineproof.sources.scratch import root

#: The state store that timers and list state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a start is told to wait while all slots are taken.
BUSY_SECONDS = 5
MARK = -(2**63)
FAR = ("2200-01-01 00:00:00", "2201-01-01 00:00:00")


def arriving(spark: SparkSession, path: str, files_each: int = 200) -> DataFrame:
    """A stream over a Parquet folder or a single file; a trigger takes at most that many files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"  # only a pattern may stand for a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each).parquet(pattern)


def landed(stream: DataFrame, mode: str = "append", before: Callable[[DataFrame, DataFrame], DataFrame] | None = None, base: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read its sink: a column batch tells the micro-batch of each row.

    before(rows, earlier) may change a micro-batch, columns kept, in view of what earlier ones left. A stream that goes
    on from an earlier run names the same base folder.
    """
    spark = stream.sparkSession
    base = base or f"{root(spark)}/lineproof/stream-{uuid.uuid4().hex}"
    table, schema = f"{base}/table", StructType([*stream.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{table}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        if before:
            rows = before(rows, rows.sparkSession.read.schema(schema).parquet(table).filter(F.col("batch") < batch))
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(table)


def merged(stream: DataFrame, key: str, version: list[str], base: str | None = None, mode: str = "append", buckets: int = BUCKETS) -> CurrentTable:
    """Merge each micro-batch of a stream into a current table; a replayed batch finds its commit and changes nothing."""
    spark = stream.sparkSession
    base = base or f"{root(spark)}/lineproof/stream-{uuid.uuid4().hex}"
    table = CurrentTable(spark, f"{base}/current", stream.schema, key, version, buckets)
    stream.writeStream.foreachBatch(lambda rows, batch: table.merge(rows, batch)).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table


def latest_snapshots(stream: DataFrame, key: str, version: list[str], columns: list[str], base: str | None = None) -> DataFrame:
    """The newest row of each key over all micro-batches, from a table of one row a key."""
    held = list(dict.fromkeys([key, *columns, *version]))
    return merged(stream.select(*held), key, version, base).read().select(key, *[c for c in columns if c != key])


def admitted(stream: DataFrame, key: str, most: int = 6, seconds: int = 60, base: str | None = None) -> DataFrame:
    """(key, event_id, admitted, retry_after): at most so many admitted starts of a key in any span of seconds.

    Refused requests do not count. The state of a key is the times of its last admitted starts, at most `most` numbers.
    Rows of one micro-batch are taken by time; a trigger's size bounds what a task holds. Times must not be null.
    """
    span = seconds * 1_000_000
    schema = f"{key} long, event_id long, admitted boolean, retry_after double"

    def decide(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"].tolist(), rows["event_id"].tolist(), strict=True):
            starts = [s for s in starts if s > at - span]
            fine = len(starts) < most
            out.append((who[0], event, fine, 0.0 if fine else (starts[0] + span - at) / 1e6))
            if fine:
                starts.append(at)
        state.update((starts,))
        yield pd.DataFrame(out, columns=[key, "event_id", "admitted", "retry_after"])

    rows = stream.select(F.col(key).cast("long"), F.col("event_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    told = rows.groupBy(key).applyInPandasWithState(decide, schema, "starts array<long>", "append", GroupStateTimeout.NoTimeout)
    return landed(told, base=base).drop("batch")


class Slots(StatefulProcessor):
    """Admission of one key in event time: waiting events until the watermark passes them, then starts and active leases.

    Times are microseconds. Events are decided in the order (at, event_id) whatever micro-batch brought them; a timer
    stands at the first one that waits. The starts kept are those of the last span, the leases those not ended, so a key
    holds `most` + `active` numbers beside what waits; when neither counts any more a timer clears them.
    """

    def __init__(self, most: int, span: int, active: int, lease: int):
        self.most, self.span, self.active, self.lease = most, span, active, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, release boolean")
        self.slots = handle.getValueState("slots", "starts array<long>, leases array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One call to the state a frame, not one an event.
        for frame in rows:
            self.waiting.appendList(list(zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["release"].tolist())))
            self.handle.registerTimer(int(frame["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ripe, later = [x for x in waiting if x[0] < limit], [x for x in waiting if x[0] >= limit]
        starts, leases = (list(x) for x in self.slots.get()) if self.slots.exists() else ([], [])
        told = []
        for at, event, release in ripe:
            starts, leases = [s for s in starts if s > at - self.span], [x for x in leases if x > at - self.lease]
            if release:
                leases = leases[1:]
                continue
            wait = BUSY_SECONDS if len(leases) >= self.active else max(1, -((at - starts[0] - self.span) // 1_000_000)) if len(starts) >= self.most else 0
            told.append((key[0], event, not wait, wait))
            if not wait:
                starts, leases = [*starts, at], [*leases, at]
        if ripe and later:
            self.waiting.put(later)
        elif ripe:
            self.waiting.clear()
        starts, leases = [s for s in starts if s > limit - self.span], [x for x in leases if x > limit - self.lease]
        if starts or leases:
            self.slots.update((starts, leases))
        else:
            self.slots.clear()
        ends = [later[0][0]] if later else [max([s + self.span for s in starts] + [x + self.lease for x in leases])] if starts or leases else []
        for at in ends:
            self.handle.registerTimer(at // 1000 + 1)
        if told:
            yield pd.DataFrame(told, columns=["key", "event_id", "admitted", "retry_after"])

    def close(self) -> None:
        pass


def closing(stream: DataFrame, base: str, step: int) -> DataFrame:
    """stream and, from step 1 on, a row of a far later time for each step, its numbers MARK, its texts empty.

    The first moves the watermark past all that waits; the second brings the micro-batch that acts on it.
    """
    spark, folder = stream.sparkSession, f"{base}/closing"
    mark = StructType([StructField(f.name, f.dataType) for f in stream.schema.fields])
    empty = spark.createDataFrame([], mark)
    empty.write.mode("ignore").parquet(f"{folder}/none")
    if step:
        values = {"timestamp": FAR[step - 1], "bigint": MARK, "boolean": False, "string": ""}
        row = spark.range(1).select(*[F.lit(values[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in mark.fields])
        row.write.mode("ignore").parquet(f"{folder}/last-{step}")
    return stream.unionByName(spark.readStream.schema(mark).option("recursiveFileLookup", "true").parquet(folder))


def admitted_with_release(stream: DataFrame, key: str, most: int = 6, seconds: int = 60, active: int = 2, lease: int = 600, late: str = "1 hour", base: str | None = None, last: bool = True) -> DataFrame:
    """(key, event_id, admitted, retry_after) of each start in a stream of (key, event_id, ts, release).

    A start is admitted while fewer than `active` of the key's starts are active and fewer than `most` were admitted in
    the last seconds; refused ones count for neither. A release ends the oldest active start, a lease of so many seconds
    ends one that is never released. retry_after is 5 where all slots are taken, else the whole seconds until the rate
    allows one, at least 1. Events may come out of order by `late`; later ones are dropped. With last the stream is taken to
    be complete after this run and what still waits is decided; a stream that goes on names its base and leaves it out.
    """
    spark = stream.sparkSession
    base = base or f"{root(spark)}/lineproof/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("release").cast("boolean"))
    schema = "key long, event_id long, admitted boolean, retry_after int"
    for step in range(1 + 2 * last):
        timed = closing(rows, base, step).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
        told = timed.groupBy("key").transformWithStateInPandas(Slots(most, seconds * 1_000_000, active, lease * 1_000_000), schema, "append", "EventTime")
        found = landed(told, base=base)
    return found.filter(F.col("event_id") != MARK).withColumnRenamed("key", key)


def correlated(requests: DataFrame, responses: DataFrame, seconds: int = 45, late: str = "1 minute", base: str | None = None, last: bool = True) -> DataFrame:
    """(request_id, n_responses, state, batch): requests (request_id, asked_at) with the responses (request_id, told_at) of their time.

    The stream itself settles each request: an outer join keeps either side as long as a partner may come, and the count
    of a request's responses leaves it in the micro-batch whose watermark passes its deadline. Exactly one response in
    time is accepted, several are refused, none falls back; responses after the deadline meet nothing. Requests without
    an id are left out. last as in admitted_with_release.
    """
    spark = requests.sparkSession
    base = base or f"{root(spark)}/lineproof/stream-{uuid.uuid4().hex}"
    for step in range(1 + 2 * last):
        a = closing(requests.select("request_id", "asked_at"), f"{base}/requests", step).withWatermark("asked_at", late)
        b = closing(responses.select(F.col("request_id").alias("answered"), "told_at"), f"{base}/responses", step).withWatermark("told_at", late)
        pairs = a.join(b, F.expr(f"request_id = answered and told_at between asked_at and asked_at + interval {seconds} seconds"), "left_outer")
        n = F.col("n_responses")
        counted = pairs.groupBy("request_id", "asked_at").agg(F.count("answered").alias("n_responses"))
        state = F.when(n == 1, "accepted").when(n > 1, "repeated").otherwise("fallback")
        found = landed(counted.select("request_id", "n_responses", state.alias("state")), base=base)
    return found.filter(F.col("request_id") != MARK)


def requested_once(stream: DataFrame, key: str = "doc_id", base: str | None = None) -> DataFrame:
    """Hashes of distinct lines, each landed by the first micro-batch that holds it.

    The state store keeps the hashes seen, dealt by hash, so that a micro-batch reads its own lines alone.
    """
    chunks = L.source_lines(stream, key).select(F.sha2("line", 256).alias("chunk_id"))
    return landed(chunks.dropDuplicates(["chunk_id"]), base=base).select("chunk_id")


def requested_each(stream: DataFrame, key: str, at: str, span: str, late: str = "10 minutes", base: str | None = None) -> DataFrame:
    """(key, start): each key once in every span of time, however often and in whatever order it comes.

    A span's keys leave the state when the watermark has passed it, so the state follows what `late` and the span hold,
    not all keys ever seen; rows later than that are dropped.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.select(F.col(key), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    once = timed.select(key, F.window("at", span).alias("span")).dropDuplicates([key, "span"])
    return landed(once.select(key, F.col("span.start").alias("start")), base=base)


def requested_within(stream: DataFrame, key: str, at: str, within: str = "10 minutes", base: str | None = None) -> DataFrame:
    """Rows of a stream without those whose key came before within that time; a key is forgotten when the watermark passes it."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return landed(stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key]), base=base)


def current_status(stages: list[DataFrame], key: str, base: str | None = None) -> DataFrame:
    """The furthest stage of each key over streams of (key, stage), from a table of one row a key; the stream keeps no state."""
    union = stages[0]
    for s in stages[1:]:
        union = union.unionByName(s)
    return merged(union.select(key, "stage"), key, ["stage"], base).read().select(key, "stage")
