"""Streams bound to the events of a folder: read in micro-batches of event time, each result as the batch version's."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.plans.bindings import _t, query
from archspark.streaming import state

SLICES = 4


def _folder(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{given or 'file://' + tempfile.mkdtemp(prefix='spark-streams-')}/events-{uuid.uuid4().hex}"


def _slices(events: DataFrame) -> Iterator[DataFrame]:
    """The events in SLICES slices of time, earliest first."""
    us = F.unix_micros("ts")
    cuts = events.agg(F.percentile_approx(us, [k / SLICES for k in range(1, SLICES)], 10_000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        after, until = F.lit(True) if low is None else us > low, F.lit(True) if high is None else us <= high
        yield events.where(after & until)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The events as a stream of SLICES files, each a slice of time, earliest first; and a folder for results."""
    events, folder = _events(spark, sf), _folder(spark)
    for part in _slices(events):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def taken_in(spark: SparkSession, events: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `state.run` returns of the events as a stream, each slice a micro-batch: written by the tasks that read it, and taken in before the next one comes."""
    folder = _folder(spark)
    for part in _slices(events):
        part.write.mode("append").parquet(f"{folder}/in")
        written = state.run(of(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), folder)
    return written


@query("""SELECT user_id AS visitor, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n_visits,
  arg_max(event_type, event_id) FILTER (event_type <> 'view' AND event_id % 3 <> 0) AS answer, arg_max(event_id % 2 = 0, event_id) FILTER (event_type <> 'view') AS flag
  FROM (SELECT user_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) AS event_id, event_id AS e FROM events) GROUP BY 1""".replace("event_id % ", "e % "))
def s2_visits_stream(spark, sf):
    """Visitors' profiles as micro-batches leave them; false is an answer as others are."""
    rows = lambda stream: stream.select(F.col("user_id").alias("visitor"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("skipped"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("answer"), (F.col("event_id") % 2 == 0).alias("flag"))
    return state.latest(taken_in(spark, _events(spark, sf).select("event_id", "ts", "user_id", "event_type"), lambda stream: state.visits(rows(stream))), "visitor")


@query("""WITH a AS (SELECT user_id AS id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id AS id, max(ts) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT id, round((epoch_us(e) - epoch_us(s)) / 1e6, 2) AS seconds, e IS NOT NULL AS ended FROM a LEFT JOIN b USING (id)""")
def s2_sessions_stream(spark, sf):
    """Sessions from a user's first signup to the last purchase; none is closed for being idle."""
    stream, folder = arriving(spark, sf)
    rows = stream.where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("id"), "ts", (F.col("event_type") == "signup").alias("starts"))
    return state.latest(state.run(state.sessions(rows, timeout_s=10**9), folder), "id").drop("closed")


@query("SELECT event_id AS id, user_id % 5 AS ip, count(*) OVER w - 1 >= 5 AS rejected FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def s2_rate_limit_stream(spark, sf):
    """Five addresses, so that an hour holds more than five requests of each."""
    stream, folder = arriving(spark, sf)
    return state.run(state.rate_limited(stream.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("ip"), "ts")), folder).drop("batch")
