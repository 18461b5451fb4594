"""Change operators: volatility, impact, drift, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Kinds of paths, by the first that applies, with their weights and names; and weights of changes.
PATH_KINDS = [(r"pom\.xml|\.yml|\.properties", 5.0, "Config/Infra Changes"), ("controller|endpoint", 4.0, "API/Contract Changes"), ("service|impl", 3.0, "Core Logic Overhaul"), ("entity|repository", 2.0, "Data Model Shifts")]
CHANGES, COMPONENTS = {"DELETE": 3.0, "MODIFY": 2.0}, {"DELETE": 1.5, "MODIFY": 1.0}


def affected_service(path: Column) -> Column:
    """First segment of a path with more than one; null else."""
    return F.nullif(F.regexp_extract(path, "^/?([^/]+)/", 1), F.lit(""))


def volatility(changes: DataFrame) -> DataFrame:
    """changes(path, change, components: array of changes) -> by service, the first segment of the path: raw weight, normalised to 1 at 20, and the kinds of risk, sorted."""
    low = F.lower("path")
    kind, name = F.lit(1.0), F.lit(None).cast("string")
    for pattern, weight, risk in reversed(PATH_KINDS):
        kind, name = F.when(low.rlike(pattern), weight).otherwise(kind), F.when(low.rlike(pattern), risk).otherwise(name)
    factor = lambda change, table, other: F.coalesce(*(F.when(change == c, w) for c, w in table.items()), F.lit(other))
    parts = F.aggregate(F.coalesce("components", F.array().cast("array<string>")), F.lit(0.0), lambda acc, c: acc + factor(c, COMPONENTS, 0.5))
    rows = changes.select(affected_service(F.col("path")).alias("service"), (kind * factor(F.col("change"), CHANGES, 1.0) + parts).alias("w"), F.array_compact(F.array(name, F.when(F.col("change") == "DELETE", "Severe Deletions"))).alias("risks")).where("service is not null")
    by = rows.groupBy("service").agg(F.sum("w").alias("raw"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("risks")))), ",").alias("risks"))
    return by.select("service", F.round("raw", 2).alias("raw"), F.round(F.least(F.lit(1.0), F.col("raw") / 20), 4).alias("volatility"), "risks")


def critical(scores: DataFrame, above: float = 0.7) -> DataFrame:
    """scores(src, dst, state, score): impacts above a score, rounded to two digits, largest first."""
    return scores.where(F.col("score") > above).select("src", "dst", "state", F.round("score", 2).alias("score")).orderBy(F.desc("score"), "src", "dst")


def counters(changes: DataFrame) -> DataFrame:
    """changes(change, components) -> number of changes and of component changes of each kind."""
    n = lambda name: (F.count_if(F.col("change") == name) + F.coalesce(F.sum(F.size(F.filter("components", lambda c: c == name))), F.lit(0)))
    return changes.agg(n("ADD").alias("added"), n("MODIFY").alias("modified"), n("DELETE").alias("deleted"))


def impact(links: DataFrame, vol: DataFrame) -> DataFrame:
    """links(src, dst, state), vol(service, volatility, centrality) -> score of each link by its state, capped at 1. Only links that exist on either side are scored, not every pair of services."""
    s = vol.select(F.col("service").alias("src"), F.col("volatility").alias("v_src"))
    t = vol.select(F.col("service").alias("dst"), F.col("volatility").alias("v_dst"), F.col("centrality").alias("c"))
    vs, vt, c = F.coalesce("v_src", F.lit(0.0)), F.coalesce("v_dst", F.lit(0.0)), F.coalesce("c", F.lit(1.0))
    score = F.when(F.col("state") == "removed", 0.75 + 0.25 * vs).when(F.col("state") == "modified", 0.4 + 0.4 * vt * c).when(F.col("state") == "added", 0.3 + 0.3 * vt).when(vt > 0, 0.15 + 0.7 * vt * c).otherwise(0.0)
    return links.join(s, "src", "left").join(t, "dst", "left").select("src", "dst", "state", F.round(F.least(F.lit(1.0), score), 2).alias("score"))


def forecast(series: DataFrame, steps: int = 3) -> DataFrame:
    """series(key, idx, y) -> least-squares continuation, not below 0; nothing for a single point."""
    last = F.max("idx")
    fit = series.groupBy("key").agg(F.regr_slope("y", "idx").alias("a"), F.regr_intercept("y", "idx").alias("b"), last.alias("last"), F.count("*").alias("n")).where("n > 1")
    ahead = fit.select("key", "a", "b", "last", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    return ahead.select("key", (F.col("last") + F.col("k")).cast("int").alias("idx"), F.round(F.greatest(F.lit(0.0), F.col("b") + F.col("a") * (F.col("last") + F.col("k"))), 2).alias("y"))


def deltas(snapshots: DataFrame) -> DataFrame:
    """snapshots(key, idx, coupling, affected) -> previous idx and risk = coupling times (affected or 1)."""
    by = Window.partitionBy("key").orderBy("idx")
    return snapshots.select("key", "idx", F.lag("idx").over(by).alias("previous"), F.round(F.col("coupling") * F.when(F.col("affected") > 0, F.col("affected")).otherwise(1), 2).alias("risk"))
