"""Visits, sessions and rate limits over streams: a keyed state each, with event-time timers that let it go.

The batch versions are in `archspark.operators.store`; over the same rows both give the same result. A stream's state lies
in the RocksDB store (`run` asks for it) and holds what the next row needs, not the rows before it: a visitor's profile, a
session's two ends, the last `limit` times of an address. `run` writes each micro-batch to a folder of its own, so that a
batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Schemas of state are built without a session: processors start in Python workers.
_ENDS = StructType([StructField("s", LongType()), StructField("e", LongType())])
_TIMES = StructType([StructField("us", LongType())])


@contextmanager
def rocksdb(spark: SparkSession):
    """RocksDB keeps the state of queries started inside; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Take in all that the source holds, in its micro-batches, and return everything written so far, with the number of its batch.

    The checkpoint is in the folder: another call with it goes on where the last one ended.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with rocksdb(spark):
        query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema, *StructType.fromDDL("batch long")])).parquet(f"{folder}/out")


def latest(written: DataFrame, key: str) -> DataFrame:
    """Of what `run` returned, the last row of each key."""
    rest = [c for c in written.columns if c not in (key, "batch")]
    return written.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, *(f"_r.{c}" for c in rest))


class _Visits(StatefulProcessor):
    """Per visitor: first and last time, number of visits, and for each answer its latest value with time and order."""

    def __init__(self, answers: list[str], state: StructType, idle_ms: int):
        self.answers, self.state, self.idle_ms = answers, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.seen.get()) if self.seen.exists() else [None, None, 0, *(None,) * (3 * len(self.answers))]
        for batch in rows:
            us = batch["us"]
            held[0] = int(us.min()) if held[0] is None else min(held[0], int(us.min()))
            held[1] = int(us.max()) if held[1] is None else max(held[1], int(us.max()))
            held[2] += len(batch)
            told = batch[~batch["skipped"].fillna(True).astype(bool)].sort_values(["us", "seq"])
            for i, name in enumerate(self.answers):
                given = told[told[name].notna()]
                at = 3 + 3 * i
                if len(given):
                    last = given.iloc[-1]
                    if held[at + 1] is None or (held[at + 1], held[at + 2]) < (int(last["us"]), int(last["seq"])):
                        value = last[name]
                        held[at : at + 3] = value.item() if hasattr(value, "item") else value, int(last["us"]), int(last["seq"])
        self.seen.update(tuple(held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[1] // 1000 + self.idle_ms)
        yield self._row(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def _row(self, key, held) -> pd.DataFrame:
        return pd.DataFrame({"visitor": [key[0]], "first_us": [held[0]], "last_us": [held[1]], "n_visits": [held[2]], **{n: [held[3 + 3 * i]] for i, n in enumerate(self.answers)}})

    def close(self) -> None:
        pass


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def visits(events: DataFrame, delay: str = "10 minutes", idle_s: int | None = None) -> DataFrame:
    """events(visitor, ts, seq, skipped, answer...) as a stream -> a visitor's profile whenever it changes: first and last time, number of visits, and per answer the latest non-null one of a visit that wasn't skipped (false is a value).

    Rows may come in any order. With idle_s, what is known of a visitor is forgotten after so long without a visit, by event time.
    """
    answers = [c for c in events.columns if c not in ("visitor", "ts", "seq", "skipped")]
    fields = {f.name: f.dataType for f in events.schema}
    state = StructType([*StructType.fromDDL("first long, last long, n long"), *(x for i, n in enumerate(answers) for x in (StructField(f"value{i}", fields[n]), *StructType.fromDDL(f"us{i} long, seq{i} long")))])
    shown = StructType([StructField("visitor", fields["visitor"]), *StructType.fromDDL("first_us long, last_us long, n_visits long"), *(StructField(n, fields[n]) for n in answers)])
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if idle_s is None:  # nothing is forgotten, so a profile is an aggregate; Spark adds up a batch's rows before they meet the state
        timed = timed.withColumn("us", _micros("ts"))
        of = lambda n: F.max_by(n, F.when(~F.coalesce("skipped", F.lit(True)) & F.col(n).isNotNull(), F.struct("us", "seq"))).alias(n)
        return timed.groupBy("visitor").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_visits"), *map(of, answers))
    timed = timed.withWatermark("ts", delay).withColumn("us", _micros("ts"))
    return timed.groupBy("visitor").transformWithStateInPandas(_Visits(answers, state, idle_s * 1000), shown, "Update", "EventTime")


class _Sessions(StatefulProcessor):
    """Per session: its earliest start and latest end; a timer closes one that doesn't end."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ends = handle, handle.getValueState("ends", _ENDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end = self.ends.get() if self.ends.exists() else (None, None)
        for batch in rows:
            starts, ends = batch.loc[batch["starts"], "us"], batch.loc[~batch["starts"], "us"]
            start = min(int(starts.min()), start) if len(starts) and start is not None else int(starts.min()) if len(starts) else start
            end = max(int(ends.max()), end) if len(ends) and end is not None else int(ends.max()) if len(ends) else end
        self.ends.update((start, end))
        if start is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(start, end or start) // 1000 + self.timeout_ms)
            yield self._row(key, start, end, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end = self.ends.get()
        self.ends.clear()
        yield self._row(key, start, end, True)

    def _row(self, key, start, end, closed) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "us": pd.array([None if end is None else end - start], dtype="Int64"), "ended": [end is not None], "closed": [closed]})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, delay: str = "10 minutes", timeout_s: int = 86_400) -> DataFrame:
    """events(id, ts, starts) as a stream: starts and ends of sessions -> id, seconds (2 digits, null before the end), ended, closed, whenever a session changes.

    A session is closed, and its state let go, when event time has passed its last start or end by timeout_s. An end without a start gives no row until the start comes.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("us", _micros("ts"))
    kind = events.schema["id"].dataType
    shown = StructType([StructField("id", kind), *StructType.fromDDL("us long, ended boolean, closed boolean")])
    out = timed.groupBy("id").transformWithStateInPandas(_Sessions(timeout_s * 1000), shown, "Update", "EventTime")
    return out.select("id", F.round(F.col("us") / 1e6, 2).alias("seconds"), "ended", "closed")


class _RateLimit(StatefulProcessor):
    """Per address: the times of its last `limit` requests. One more is too many if all of them lie within the window."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", _TIMES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = sorted(r[0] for r in self.recent.get()) if self.recent.exists() else []
        batch = pd.concat(list(rows)).sort_values(["us", "id"])
        rejected = []
        for us, n in batch.groupby("us", sort=True).size().items():
            prior = sum(us - t <= self.window_us for t in recent) + n - 1
            rejected += [prior >= self.limit] * n
            recent = (recent + [int(us)] * min(int(n), self.limit))[-self.limit :]
        self.recent.put([(t,) for t in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((recent[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "ip": [key[0]] * len(batch), "rejected": rejected})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int = 5, seconds: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """requests(id, ip, ts) as a stream -> id, ip, rejected: decided when it comes, against what came before it and what shares its time: rejected where the hour up to it already holds `limit` others of the address.

    Rejected requests count as well. An address is forgotten an hour after its last request. Requests of one time must come in one micro-batch for the result to be the batch version's.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("us", _micros("ts"))
    shown = StructType([StructField("id", requests.schema["id"].dataType), StructField("ip", requests.schema["ip"].dataType), *StructType.fromDDL("rejected boolean")])
    return timed.groupBy("ip").transformWithStateInPandas(_RateLimit(limit, seconds * 1_000_000), shown, "Update", "EventTime")
