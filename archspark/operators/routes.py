"""URL templates as a trie, and the endpoints that remote calls mean.

A template's segments lead from its HTTP method through nodes to an end; a variable is one more branch of its node. Paths
walk the trie a level at a time, each level an equality of node and segment, so that a path meets the templates it agrees
with so far and no others. Where it ends it meets the templates of the service asked for, or the first of any service.
Nodes are hashes of what leads to them; what is found is compared again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.operators.enrich import first_of, fuzzy
from archspark.operators.graph import checkpointed

#: Copies of the trie's branches, dealt to paths by hash: a branch that most paths take is many keys of the join.
SALTS = 16
#: Levels walked in one plan.
LEVELS = 8
VARIABLE = "{}"


def normal_service(name: Column) -> Column:
    """A service's name without case, dashes, underscores and the prefix ts, ms or svc."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit("unknown"))), "[-_]", ""), "^(ts|ms|svc)", "")


def normal_path(url: Column) -> Column:
    """A URL without host, query and the slashes at its ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+", ""), r"\?.*$", ""), "^/+|/+$", "")


def service_of_path(path: Column) -> Column:
    """The service that a path names: `/api/v1/orderservice/..` and `/api/v1/order_service/..` mean ts-order-service; else the first segment that holds `service` and something besides; null without one."""
    name = lambda part: F.concat(F.lit("ts-"), part, F.lit("-service"))
    joined = F.regexp_extract(path, r"/api/v\d+/([a-zA-Z]+[Ss]ervice)/", 1)
    marked = F.regexp_extract(path, r"/api/v\d+/([a-zA-Z_]+)_service/", 1)
    rest = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), "service", ""), "_", "-"), "-+", "-"), "^-|-$", "")
    others = F.filter(F.transform(F.filter(F.split(path, "/"), lambda s: F.lower(s).contains("service")), rest), lambda s: s != "")
    return F.when(joined != "", name(F.regexp_replace(F.lower(joined), "service$", ""))).when(marked != "", name(F.regexp_replace(F.lower(marked), "_", "-"))).otherwise(name(F.get(others, F.lit(0))))


def segments(path: Column) -> Column:
    """Segments of a normal path; none for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def _is_variable(segment: Column) -> Column:
    return segment.rlike(r"^\{.*\}$")


def _child(node: Column, segment: Column) -> Column:
    return F.xxhash64(node, segment)


@dataclass
class Routes:
    """A trie: branches(node, segment, child, salt), ends(node, name, pos, template, fixed), and the templates it was made of."""

    branches: DataFrame
    ends: DataFrame
    depth: int
    known: DataFrame


def trie(templates: DataFrame) -> Routes:
    """templates(pos, service, method, template) as a trie; of a service's templates with the same segments the first by pos counts."""
    known = templates.select("pos", "service", normal_service(F.col("service")).alias("name"), F.upper("method").alias("method"), "template")
    norm = known.withColumns({"_s": F.transform(segments(normal_path(F.col("template"))), lambda s: F.when(_is_variable(s), VARIABLE).otherwise(F.lower(s))), "_root": F.xxhash64("method")})
    start = F.array(F.struct(F.lit("").alias("segment"), F.col("_root").alias("node"), F.col("_root").alias("child")))
    way = F.aggregate("_s", start, lambda acc, s: F.concat(acc, F.array(F.struct(s.alias("segment"), F.element_at(acc, -1)["child"].alias("node"), F.xxhash64(F.element_at(acc, -1)["child"], s).alias("child")))))
    walked = checkpointed(norm.withColumn("_way", way))
    branches = walked.select(F.explode(F.slice("_way", F.lit(2), F.size("_s"))).alias("x")).select("x.node", "x.segment", "x.child").distinct()
    ends = walked.select(F.element_at("_way", -1)["child"].alias("node"), "name", "service", "method", "pos", "template", F.size(F.filter("_s", lambda s: s != VARIABLE)).alias("fixed"))
    depth = walked.agg(F.max(F.size("_s"))).first()[0] or 0
    salted = branches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return Routes(checkpointed(salted), first_of(ends, ["node", "name"], "pos"), depth, known)


def matches(path: Column, template: Column) -> Column:
    """Whether a normal path fits a template: equal segments, case aside, and letters, digits, `.`, `_` and `-` (200 at most) for a variable."""
    ok = lambda p, t: F.coalesce(F.when(_is_variable(t), p.rlike("^[A-Za-z0-9._-]{1,200}$")).otherwise(F.lower(p) == F.lower(t)), F.lit(False))
    return F.forall(F.zip_with(segments(path), segments(normal_path(template)), ok), lambda x: x)


def reached(paths: DataFrame, routes: Routes) -> DataFrame:
    """paths(method, url) -> method, url, node: where each path ends, at a node for each choice of fixed and variable segments that the trie has for it."""
    here = paths.select(F.upper("method").alias("method"), "url").where("method is not null and url is not null").distinct()
    here = here.withColumns({"_s": segments(normal_path(F.col("url"))), "node": F.xxhash64("method"), "salt": F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")}).where(F.size("_s") <= routes.depth)
    for level in range(routes.depth):
        at, s = F.size("_s") > level, F.get("_s", F.lit(level))
        ways = F.array_compact(F.array(F.when(~_is_variable(s), F.lower(s)), F.when(s.rlike("^[A-Za-z0-9._-]{1,200}$"), F.lit(VARIABLE))))
        asked = here.withColumn("segment", F.explode(F.when(at, ways).otherwise(F.array(F.lit(None).cast("string")))))
        here = asked.join(routes.branches, ["node", "segment", "salt"], "left").where(F.col("child").isNotNull() | ~at).select("method", "url", "_s", F.coalesce("child", "node").alias("node"), "salt")
        here = checkpointed(here) if level % LEVELS == LEVELS - 1 and level + 1 < routes.depth else here
    return checkpointed(here.select("method", "url", "node"))


def _normal(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn(path, normal_path(F.col(path)))


def resolved(asked: DataFrame, reach: DataFrame, routes: Routes, least: int = 90) -> DataFrame:
    """asked(service, method, url), where they get to, and the routes -> service, method, url, pos, template, how: the template of that service that fits, of most fixed segments first, then by pos (`exact`); else the one it agrees with by `least` per cent of its fixed segments (`fuzzy`). Calls without one are left out."""
    asked = asked.where("service is not null and method is not null and url is not null").select("service", "method", "url").distinct().withColumn("name", normal_service(F.col("service")))
    met = asked.join(reach, ["method", "url"]).join(routes.ends.drop("service", "method"), ["node", "name"]).where(matches(normal_path(F.col("url")), F.col("template")))
    exact = met.groupBy("name", "method", "url").agg(F.min_by(F.struct("pos", "template"), F.struct(-F.col("fixed"), "pos")).alias("b"))
    both = asked.join(exact, ["name", "method", "url"], "left")
    missed = both.where("b is null").select(F.struct("service", "method", "url").alias("id"), F.col("name").alias("service"), "method", "url")
    named = routes.known.select("pos", F.col("name").alias("service"), "method", "template")
    close = fuzzy(_normal(missed, "url"), _normal(named, "template"), least).select("id.*", "pos").join(named.select("pos", "template"), "pos")
    return both.where("b is not null").select("service", "method", "url", "b.*", F.lit("exact").alias("how")).unionByName(close.withColumn("how", F.lit("fuzzy")))


def discovered(asked: DataFrame, reach: DataFrame, routes: Routes, least: int = 80) -> DataFrame:
    """asked(method, url), where they get to, and the routes -> method, url, found: the service of the first template of that method that fits, whatever its service, else of the one it agrees with most, by `least` per cent."""
    asked = asked.where("method is not null and url is not null").select("method", "url").distinct()
    anyone = first_of(routes.ends.drop("method"), ["node"], "pos")
    met = asked.join(reach, ["method", "url"]).join(anyone, "node").where(matches(normal_path(F.col("url")), F.col("template")))
    both = asked.join(met.groupBy("method", "url").agg(F.min_by("service", "pos").alias("found")), ["method", "url"], "left")
    missed = _normal(both.where("found is null").select(F.struct("method", "url").alias("id"), "method", "url"), "url")
    close = fuzzy(missed, _normal(routes.known.select("pos", "service", "method", "template"), "template"), least, by_service=False)
    return both.where("found is not null").unionByName(close.select("id.*", F.col("found_service").alias("found")))


def resolved_calls(calls: DataFrame, templates: DataFrame) -> DataFrame:
    """calls(id, service, method, url), templates(pos, service, method, template, endpoint) -> id, service, endpoint, template, how: the endpoint that each remote call means, or null; an endpoint is never made up.

    A call's service is its own (`own`) or the one its path names (`path`). Where it has neither (`index`), or none of that
    service's endpoints fits (`retry`), it is the service of the endpoint that its URL meets among all services. A call whose
    endpoint isn't found keeps the service that was found last.
    """
    routes = trie(templates)
    named = calls.select("id", F.upper("method").alias("method"), "url", F.coalesce("service", service_of_path(F.col("url"))).alias("service"), F.col("service").isNotNull().alias("own"))
    reach = reached(named, routes)
    first = checkpointed(named.join(resolved(named, reach, routes).drop("how"), ["service", "method", "url"], "left"))
    found = checkpointed(discovered(first.where("pos is null"), reach, routes))
    second = resolved(found.withColumnRenamed("found", "service"), reach, routes).select(F.col("service").alias("found"), "method", "url", F.col("pos").alias("again"), F.col("template").alias("again_template"))
    met = first.join(found.join(second, ["found", "method", "url"], "left"), ["method", "url"], "left")
    direct, retried = F.col("pos").isNotNull(), F.col("again").isNotNull()
    how = F.when(direct & F.col("own"), "own").when(direct, "path").when(retried & F.col("service").isNull(), "index").when(retried, "retry")
    service = F.when(~direct & (retried | F.col("service").isNull()), F.col("found")).otherwise(F.col("service"))
    told = met.select("id", service.alias("service"), F.coalesce("pos", "again").alias("pos"), F.coalesce("template", "again_template").alias("template"), how.alias("how"))
    return told.join(templates.select("pos", "endpoint"), "pos", "left").select("id", "service", "endpoint", "template", "how")
