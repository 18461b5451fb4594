"""Streams with state: stopped and started again from their checkpoint, out of order, and with timers that let state go."""

import datetime as dt

from pyspark.sql import functions as F

from archspark.operators import store
from archspark.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rate_limit_goes_on_after_a_restart(spark, tmp_path):
    schema = "id long, ip string, ts timestamp"
    rows = [(k, "hot" if k % 3 else f"ip{k % 9}", at(k * 4 // 3 * 3)) for k in range(300)]
    for part in (rows[:90], rows[90:180]):
        feed(spark, part, schema, f"{tmp_path}/in")
    state.run(state.rate_limited(source(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/q")
    feed(spark, rows[180:], schema, f"{tmp_path}/in")
    got = state.run(state.rate_limited(source(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/q")
    assert got.select("batch").distinct().count() >= 3
    want = store.rate_limited(spark.createDataFrame(rows, schema)).select("id", "ip", "rejected")
    assert rows_of(got.drop("batch")) == rows_of(want)
    assert 0 < want.where("rejected").count() < 300


def test_visits_in_any_order(spark, tmp_path):
    schema = "visitor long, ts timestamp, seq long, skipped boolean, name string, agreed boolean"
    rows = [(k % 7, at(k * 37 % 100), k, k % 5 == 0, None if k % 3 else f"n{k}", None if k % 4 else k % 8 == 0) for k in range(120)]
    for part in (rows[80:], rows[:40], rows[40:80]):
        feed(spark, part, schema, f"{tmp_path}/in")
    got = state.latest(state.run(state.visits(source(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/q"), "visitor")
    want = store.visits(spark.createDataFrame(rows, schema)).select("visitor", F.unix_micros("first_seen"), F.unix_micros("last_seen"), "n_visits", "name", "agreed")
    assert rows_of(got) == rows_of(want) and any(r.agreed is False for r in got.collect())


def test_sessions_close_by_event_time(spark, tmp_path):
    schema = "id long, ts timestamp, starts boolean"
    for part in ([(1, at(0), True), (2, at(1), True)], [(2, at(6), False), (3, at(7), False)], [(4, at(600), True)], [(5, at(601), True)]):
        feed(spark, part, schema, f"{tmp_path}/in")
    got = state.run(state.sessions(source(spark, schema, f"{tmp_path}/in"), timeout_s=3600), f"{tmp_path}/q")
    assert {(r.id, r.seconds, r.ended) for r in got.where("closed").collect()} == {(1, None, False), (2, 300.0, True)}
    assert rows_of(state.latest(got, "id").select("id", "closed")) == [(1, True), (2, True), (4, False), (5, False)]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    schema = "id long, ip string, ts timestamp"
    feed(spark, [(1, "a", at(0)), (2, "a", at(1))], schema, f"{tmp_path}/in")
    first = state.run(state.rate_limited(source(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/q").collect()
    for f in (tmp_path / "q/checkpoint/commits").glob("*"):  # as if the driver was lost before the batch was committed
        f.unlink()
    again = state.run(state.rate_limited(source(spark, schema, f"{tmp_path}/in")), f"{tmp_path}/q").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


def test_profiles_without_a_timer_need_no_call_to_the_state_server(spark, tmp_path):
    feed(spark, [(1, at(0), 0, False, "a")], "visitor long, ts timestamp, seq long, skipped boolean, name string", f"{tmp_path}/v")
    rows = source(spark, "visitor long, ts timestamp, seq long, skipped boolean, name string", f"{tmp_path}/v")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan(state.visits(rows, idle_s=60)) and "TransformWithState" not in plan(state.visits(rows))
