"""Store and per-key state operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions.text import flexible_name


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest `order` per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` that have their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def version_order(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def next_versions(versions: DataFrame) -> DataFrame:
    """versions(name, version) -> latest, and the next patch, minor and major version."""
    top = versions.where(F.col("version").rlike(r"^\d+\.\d+\.\d+$")).groupBy("name").agg(F.max_by("version", version_order(F.col("version"))).alias("latest"))
    v = version_order(F.col("latest"))
    return top.select("name", "latest", F.concat_ws(".", v[0], v[1], v[2] + 1).alias("patch"), F.concat_ws(".", v[0], v[1] + 1, F.lit(0)).alias("minor"), F.concat_ws(".", v[0] + 1, F.lit(0), F.lit(0)).alias("major"))


def retained(df: DataFrame, version: str, created: str, now: Column, days: int = 30) -> DataFrame:
    """All but rows without version that are older than so many days."""
    return df.where(F.col(version).isNotNull() | (F.col(created) >= now - F.expr(f"INTERVAL {days} DAYS")))


def visits(events: DataFrame) -> DataFrame:
    """events(visitor, ts, seq, skipped, answer...) -> first and last seen, count, and per answer the latest non-null one of a visit that wasn't skipped."""
    answers = [c for c in events.columns if c not in ("visitor", "ts", "seq", "skipped")]
    given = lambda c: F.when(~F.col("skipped") & F.col(c).isNotNull(), F.struct("ts", "seq"))
    return events.groupBy("visitor").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n_visits"), *(F.max_by(c, given(c)).alias(c) for c in answers))


def rate_limited(requests: DataFrame, limit: int = 5, seconds: int = 3600) -> DataFrame:
    """requests(id, ip, ts): rejected where the hour up to it (inclusive) already holds `limit` others of the ip."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("ip").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    prior = F.count("*").over(w) - 1
    return requests.select("id", "ip", prior.alias("prior"), (prior >= limit).alias("rejected"))


def sessions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """starts(id, ts), ends(id, ts) -> duration in seconds, null where a session hasn't ended."""
    both = starts.select("id", F.col("ts").alias("s")).join(ends.select("id", F.col("ts").alias("e")), "id", "left")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return both.select("id", F.round((us("e") - us("s")) / 1e6, 2).alias("seconds"), F.col("e").isNotNull().alias("ended"))


def budget_step(spend: DataFrame, steps: DataFrame, budget: float, ceiling: int) -> DataFrame:
    """spend(day, cost), steps(at_percent, capacity): month to date as a share of the budget, and the capacity of the highest step not above it, between 1 and the ceiling. The step table is a configuration of a few rows."""
    to_date = F.sum("cost").over(Window.partitionBy(F.date_trunc("month", "day")).orderBy("day"))
    used = spend.select("day", F.round(100 * to_date / budget, 4).alias("percent"))
    met = used.join(F.broadcast(steps), F.col("at_percent") <= F.col("percent"), "left").groupBy("day", "percent").agg(F.max_by("capacity", "at_percent").alias("declared"))
    return met.select("day", "percent", F.greatest(F.lit(1), F.least(F.coalesce("declared", F.lit(ceiling)), F.lit(ceiling))).alias("capacity"))


def append_new(kept: DataFrame, fetched: DataFrame, key: list[str]) -> DataFrame:
    """The kept rows and those fetched ones whose key is not among them."""
    return kept.unionByName(fetched.join(kept.select(*key).distinct(), key, "left_anti"))


def by_name(systems: DataFrame, name: str, newest: int | None = None) -> DataFrame:
    """systems(id, name, version, ...): released rows whose name holds a pattern (case, dashes, underscores and spaces aside), newest version first by its numbers."""
    found = systems.where(F.col("name").rlike("(?i)" + flexible_name(name)) & F.col("version").isNotNull()).orderBy(F.desc(version_order(F.col("version"))), "id")
    return found.limit(newest) if newest else found


def exists(systems: DataFrame, name: str) -> bool:
    return not by_name(systems, name).isEmpty()


def versions(systems: DataFrame, name: str) -> DataFrame:
    """Version, id, creation and description of a system's released rows, newest version first."""
    return systems.where((F.col("name") == name) & F.col("version").isNotNull()).select("version", "id", "created", "description").orderBy(F.desc(version_order(F.col("version"))), "id")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids(key), each once."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def listing(df: DataFrame, order: list[Column], number: int, size: int, without: list[str]) -> DataFrame:
    """A page without some columns; updated falls back to created; every row has the number of rows and pages in all."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    rows = page(df.withColumn("updated", F.coalesce("updated", "created")).drop(*without), order, number, size)
    return rows.crossJoin(F.broadcast(total))  # one row


def with_version(systems: DataFrame, key: Column, version: str, description: str | None = None) -> DataFrame:
    """systems(version, payload as JSON, ...) with a version set where key holds: in the row, and at the root of a payload that is an object (what lies deeper keeps its own). A description is set along with it where the table has one."""
    if not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError(f"no version: {version}")
    root = F.from_json("payload", "map<string, variant>")
    rest = F.filter(F.map_entries(root), lambda e: e["key"] != "version")
    entry = F.array(F.struct(F.lit("version").alias("key"), F.parse_json(F.lit(f'"{version}"')).alias("value")))
    payload = F.coalesce(F.when(F.col("payload").rlike(r"^\s*\{"), F.to_json(F.map_from_entries(F.concat(rest, entry)))), F.col("payload"))
    columns = {"version": F.when(key, version).otherwise(F.col("version")), "payload": F.when(key, payload).otherwise(F.col("payload"))}
    if "description" in systems.columns:
        columns["description"] = F.when(key, F.lit(description)).otherwise(F.col("description"))
    return systems.withColumns(columns)


def cached(wanted: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored results of the keys wanted, and the keys that have none yet."""
    return by_ids(results, wanted, key), wanted.join(results.select(key).distinct(), key, "left_anti")
