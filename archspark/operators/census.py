"""Counts over endpoints, issues, spending and quotas."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators.graph import checkpointed


def endpoint_statistics(endpoints: DataFrame) -> DataFrame:
    """endpoints(service, method, controller, is_public) -> counts by service, by method and of all in one pass: service, method (null: all), n, controllers, public."""
    sets = endpoints.groupingSets([["service"], ["method"], []], "service", "method")
    return sets.agg(F.count("*").alias("n"), F.countDistinct("controller").alias("controllers"), F.count_if("is_public").alias("public"), F.grouping("service").cast("long").alias("all_services"), F.grouping("method").cast("long").alias("all_methods"))


#: Severities that a census lists even where there is no issue of them.
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")


def issue_severities(issues: DataFrame) -> DataFrame:
    """issues(severity, minutes) -> severity, n, hours (minutes over 60, one digit), with zeros for severities without issues."""
    every = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    by = issues.groupBy("severity").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"))
    return every.join(by, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0)) / 60, 1).alias("hours"))


def issue_rules(issues: DataFrame) -> DataFrame:
    """issues(pos, rule, severity, message) -> rule, n, and severity and message of its first issue."""
    return issues.groupBy("rule").agg(F.count("*").alias("n"), F.min_by("severity", "pos").alias("severity"), F.min_by("message", "pos").alias("message"))


def issue_files(issues: DataFrame, top: int = 10) -> DataFrame:
    """issues(pos, file) -> the files (without folders) of most issues, those seen first before others of as many."""
    name = F.element_at(F.split("file", "[/:]"), -1)
    return issues.groupBy(name.alias("file")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(top).select("file", "n")


def walked(documents: DataFrame, text: str = "data") -> DataFrame:
    """documents(id, JSON text) -> id, key, inside, kind, text: every value at any depth, with its key in an object (null in a list), whether what holds it is an object, its type, and itself: a text as it is, all else as JSON. One pass over what is nested for each level."""
    here = documents.select("id", F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(text)).alias("value"), F.lit(False).alias("inside")).where("value is not null")
    kind, levels = F.schema_of_variant("value"), []
    while True:
        levels.append(here.select("id", "key", "inside", kind.alias("kind"), F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).otherwise(F.to_json("value")).alias("text")))
        nested = here.where(kind.rlike("^(OBJECT|ARRAY)")).select("id", F.col("value").alias("v"), kind.startswith("OBJECT").alias("inside"))
        nested.createOrReplaceTempView(view := f"walked_{uuid.uuid4().hex}")
        here = checkpointed(nested.sparkSession.sql(f"SELECT id, x.key, x.value, inside FROM {view}, LATERAL variant_explode(v) AS x"))
        nested.sparkSession.catalog.dropTempView(view)
        if here.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def anti_patterns(documents: DataFrame, text: str = "data") -> DataFrame:
    """documents(id, JSON text) -> id, name, n: how often an anti-pattern is named anywhere in the document: as the text of a key `antiPattern`, or in a list under `antiPatterns` (elements that are no texts by their JSON)."""
    values = walked(documents, text).where("inside")
    one = values.where("key = 'antiPattern' and kind = 'STRING' and text != ''").select("id", F.col("text").alias("name"))
    many = values.where("key = 'antiPatterns' and kind like 'ARRAY%'").select("id", F.explode(F.from_json("text", "array<string>")).alias("name"))
    return one.unionByName(many).groupBy("id", "name").agg(F.count("*").alias("n"))


def spending(costs: DataFrame) -> DataFrame:
    """costs(day, cost) -> month, cost, days, day of the highest cost (the first of equals) and that cost."""
    by_day = costs.groupBy("day").agg(F.round(F.sum("cost"), 2).alias("cost"))
    top = F.max_by(F.struct("day", "cost"), F.struct("cost", -F.unix_date("day"))).alias("top")
    by = by_day.groupBy(F.trunc("day", "month").alias("month")).agg(F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("days"), top)
    return by.select(F.date_format("month", "yyyy-MM").alias("month"), "cost", "days", F.date_format("top.day", "yyyyMMdd").alias("top_day"), F.col("top.cost").alias("top_cost"))


def over_quota(deployments: DataFrame, quotas: DataFrame) -> DataFrame:
    """deployments(key, used, managed, target), quotas(key, limit) -> key, wanted, limit of the keys where used - managed + all targets exceeds the limit."""
    by = deployments.groupBy("key").agg((F.max("used") - F.sum("managed") + F.sum("target")).alias("wanted"))
    return by.join(quotas, "key").where(F.col("wanted") > F.col("limit")).select("key", "wanted", "limit")
