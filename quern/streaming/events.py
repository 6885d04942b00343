"""Event windows and stateful limits, on bounded tables and on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from quern.sources import versions


def with_time(events: DataFrame) -> DataFrame:
    """Adds time (timestamp, UTC) and sec (epoch seconds)."""
    time = F.col("ts").cast("timestamp")
    return events.withColumns({"time": time, "sec": F.unix_micros(time) / 1e6})


def recent_hits(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Adds hits: events of the user in the `seconds` up to and including each event (an upper bound of a limiter's count)."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros("time")).rangeBetween(-int(seconds * 1_000_000), 0)
    return with_time(events).withColumn("hits", F.count(F.lit(1)).over(w))


def streamed(rows: DataFrame, key: str, order: list[str], start, schema: str) -> DataFrame:
    """All rows of one key after the other, in order, through a state of their own: start() gives a function from a data frame of
    some of a key's next rows to the rows that come out.

    A key's rows are sorted by Spark, which spills, and read in batches, so memory holds one batch and the state. One task reads
    all rows of a key, as what is asked depends on all of its answers before: a hot key is one long task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for pdf in batches:
            keys = pdf[key].to_numpy()
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, z in zip(edges, edges[1:]):
                if a < z:
                    if step is None or keys[a] != at:
                        at, step = keys[a], start()
                    yield step(pdf.iloc[a:z])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def sliding_limit(events: DataFrame, limit: int = 30, seconds: float = 60.0) -> DataFrame:
    """event_id, user_id, allowed: a sliding log a user; rejected events are not recorded. State: the allowed times of the last
    `seconds`, `limit` at most."""

    def start():
        log: deque[float] = deque()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            allowed = []
            for t in pdf["sec"]:
                while log and t - log[0] > seconds:
                    log.popleft()
                allowed.append(len(log) < limit)
                if allowed[-1]:
                    log.append(t)
            return pdf[["event_id", "user_id"]].assign(allowed=allowed)

        return step

    return streamed(with_time(events).select("event_id", "user_id", "sec"), "user_id", ["sec", "event_id"], start, "event_id long, user_id long, allowed boolean")


def token_bucket(events: DataFrame, cost: str, rate: float, capacity: float, per_second: float | None = None) -> DataFrame:
    """event_id, user_id, wait: seconds until the user's buckets, refilled by elapsed time, hold what the event takes: its cost (at
    most `capacity`) of one and, if `per_second` is given, one request of another that holds and refills so many. Events go one
    after the other. State: two levels and a time."""
    rates = [(rate, capacity)] + ([(per_second, per_second)] if per_second else [])

    def start():
        level, now = [c for _, c in rates], None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal now
            waits = []
            for t, c in zip(pdf["sec"], pdf["cost"]):
                begin = t if now is None else max(t, now)
                passed = begin - (begin if now is None else now)
                need = [min(c, capacity), 1.0]
                for k, (r, most) in enumerate(rates):
                    level[k] = min(most, level[k] + passed * r)
                wait = max(0.0, *((need[k] - level[k]) / r for k, (r, _) in enumerate(rates)))
                for k, (r, most) in enumerate(rates):
                    level[k] = min(most, level[k] + wait * r) - need[k]
                now = begin + wait
                waits.append(now - t)
            return pdf[["event_id", "user_id"]].assign(wait=waits)

        return step

    rows = with_time(events).select("event_id", "user_id", "sec", F.col(cost).cast("double").alias("cost"))
    return streamed(rows, "user_id", ["sec", "event_id"], start, "event_id long, user_id long, wait double")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of event-time windows. On a stream, set a watermark first."""
    return events.groupBy(F.window("time", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("time", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("time", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_stream(spark, folder: str, table: str, schema) -> DataFrame:
    """The table's Parquet, one file or a folder of them, as a stream of files, with event time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return with_time(reader.parquet(f"{folder}/{table}") if whole else reader.option("pathGlobFilter", table).parquet(folder))


def drained(stream: DataFrame, path: str, mode: str = "append", schema=None) -> DataFrame:
    """All that is available of a stream, written exactly once as Parquet under `path`, read back."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers and typed state variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Limiter(StatefulProcessor):
    """The sliding log of a user. Its state ends by a timer when the last allowed time has left the window."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("log", "log array<double>, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["sec", "event_id"])
        held, last = self.state.get() if self.state.exists() else ([], float("-inf"))
        log, allowed = deque(held), []
        for t in pdf["sec"]:
            if t < last:  # an answer can't change those that have been given
                allowed.append(None)
                continue
            while log and t - log[0] > self.seconds:
                log.popleft()
            allowed.append(len(log) < self.limit)
            if allowed[-1]:
                log.append(t)
            last = t
        self.state.update((list(log), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.seconds) * 1000) + 1)
        late = [a is None for a in allowed]
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "user_id": key[0], "allowed": pd.array(allowed, "boolean"), "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_limit(stream: DataFrame, limit: int = 30, seconds: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, allowed, late: the sliding log on a stream, each event once within the watermark's delay. An event that
    is earlier than one of its user's that has been answered is late: allowed is null. A user's state is gone `seconds` after the
    last event, by an event-time timer. Start it inside keyed_state(). A user's events of one trigger are one task's; bound
    triggers (maxFilesPerTrigger) where one user may send very many."""
    once = stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["event_id"])
    schema = "event_id long, user_id long, allowed boolean, late boolean"
    return once.select("event_id", "user_id", "sec", "time").groupBy("user_id").transformWithStateInPandas(_Limiter(limit, seconds), schema, "append", "eventTime")


def upsert_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Starts a query that keeps the versioned table at `path` up to date: each batch's rows replace those of their keys. A batch
    that is sent again, after a failure, is in the table already and changes nothing."""
    spark, schema = stream.sparkSession, stream.schema
    if not versions.numbers(spark, path):
        versions.create(spark.createDataFrame([], schema), path, keys, 8)

    def put(rows: DataFrame, batch: int) -> None:
        versions.upsert(rows, path, batch)

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upserted(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """All that is available of a stream of updates: the last row of each key, open windows included."""
    upsert_sink(stream, f"{path}/table", keys, f"{path}/checkpoint").awaitTermination()
    return versions.read(stream.sparkSession, f"{path}/table")


class Progress(StreamingQueryListener):
    """Tells `note` of each trigger of the streams that run while it is attached: rows read, rows too late, rows held as state, and
    what DataFrame.observe() has counted."""

    def __init__(self, note: Callable[[dict], None]) -> None:
        self.note = note

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        held = {"state": sum(s.numRowsTotal for s in p.stateOperators), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        self.note({"batch": p.batchId, "rows": p.numInputRows} | held | {k: v.asDict() for k, v in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def last_use_hits(requests: DataFrame, key: str, size: int) -> DataFrame:
    """event_id, hit of a cache of `size` entries that evicts the entry not used for longest; one cache a user. State: the entries."""

    def start():
        held: dict = {}

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            hits = []
            for k in pdf["key"]:
                hits.append(k in held)
                held.pop(k, None)
                held[k] = True
                if len(held) > size:
                    del held[next(iter(held))]
            return pdf[["event_id"]].assign(hit=hits)

        return step

    return streamed(with_time(requests).select("event_id", "user_id", "sec", F.col(key).alias("key")), "user_id", ["sec", "event_id"], start, "event_id long, hit boolean")
