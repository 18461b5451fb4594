"""Joins by name and URL: enrichment of endpoints, fuzzy templates, rule merging, coverage, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def suffixes(path: Column) -> Column:
    """Every end of a path: itself and what begins behind its first, second .. character; a match by suffix is then an equality."""
    return F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.length(path)))


def enriched(scenarios: DataFrame, endpoints: DataFrame) -> DataFrame:
    """scenarios(id, uri, method), endpoints(pos, uri, method, endpoint) -> id, endpoint, how: the first endpoint of equal URI and method, else the first of that method where one URI ends with the other, else null.

    Suffix matches meet by equality on the method and the shorter URI, once for every end of the longer one.
    """
    s = scenarios.select("id", F.col("uri").alias("s_uri"), "method")
    e = first_of(endpoints.select("pos", F.col("uri").alias("e_uri"), "method", "endpoint"), ["method", "e_uri"], "pos")  # of equal URIs only the first can be the answer
    exact = s.join(e, (s["method"] == e["method"]) & (s["s_uri"] == e["e_uri"])).select("id", F.lit(0).alias("rank"), "pos", "endpoint")
    ends_s = s.where("s_uri != ''").select("id", "method", F.explode(F.array_distinct(suffixes(F.col("s_uri")))).alias("e_uri"))
    ends_e = e.where("e_uri != ''").select("pos", "endpoint", "method", F.explode(F.array_distinct(suffixes(F.col("e_uri")))).alias("s_uri"))
    partial = ends_s.join(e, ["method", "e_uri"]).select("id", "pos", "endpoint").union(ends_e.join(s.where("s_uri != ''"), ["method", "s_uri"]).select("id", "pos", "endpoint"))
    best = first_of(exact.unionByName(partial.select("id", F.lit(1).alias("rank"), "pos", "endpoint")), ["id"], "rank", "pos")
    how = F.when(F.col("rank") == 0, "exact").when(F.col("rank") == 1, "suffix").otherwise("none")
    return s.select("id").distinct().join(best, "id", "left").select("id", "endpoint", how.alias("how"))


def confidence(url: Column, template: Column) -> Column:
    """Agreement of two URLs position by position, 0 to 100: the share of fixed segments that are equal (case aside); 0 where their numbers of segments differ or a variable meets a fixed segment; 100 where all are variables."""
    u, t = F.split(url, "/"), F.split(template, "/")
    variable = lambda s: s.rlike(r"^\{.*\}$")
    state = F.zip_with(u, t, lambda a, b: F.when(a.isNull() | b.isNull() | (variable(a) != variable(b)), -1).when(variable(a) | (a == ""), 2).when(F.lower(a) == F.lower(b), 1).otherwise(0))
    n = lambda k: F.size(F.filter(state, lambda x: x == k))
    fixed = n(1) + n(0)
    return F.when((F.size(u) != F.size(t)) | (n(-1) > 0), 0).when(fixed == 0, 100).otherwise(F.floor(100 * n(1) / F.when(fixed > 0, fixed))).cast("int")


def fuzzy(urls: DataFrame, templates: DataFrame, least: int = 90, by_service: bool = True) -> DataFrame:
    """urls(id, service, method, url), templates(pos, service, method, template) -> id, pos, template, score: the first template of the highest confidence, if that reaches `least`.

    Only those of one method, number of segments and pattern of variables may agree, and of one service unless by_service is false (then any service may be found).
    With at most d of the fixed segments different, one of d + 1 groups of them is equal, so that pairs meet by equality on such a group.
    """
    own = ["service"] if by_service else []
    variable = lambda s: s.rlike(r"^\{.*\}$")
    shape = lambda c: F.array_join(F.transform(F.split(c, "/"), lambda s: F.when(variable(s), "v").otherwise("s")), "")

    def keyed(df: DataFrame, path: str) -> DataFrame:
        fixed = df.withColumns({"shape": shape(F.col(path)), "_f": F.transform(F.filter(F.split(path, "/"), lambda s: ~variable(s) & (s != "")), F.lower)})
        groups = fixed.withColumn("_n", F.floor(F.size("_f") * (100 - least) / 100).cast("int") + 1)
        return groups.withColumn("group", F.explode(F.expr("transform(sequence(0, _n - 1), g -> named_struct('g', g, 'n', _n, 'h', xxhash64(array_join(filter(_f, (s, i) -> i % _n = g), '/'))))"))).drop("_f", "_n")

    t = first_of(templates.select("pos", "service", "method", "template", F.lower("template").alias("_same")), ["service", "method", "_same"], "pos").drop("_same")
    u, t = keyed(urls.select("id", *own, "method", "url"), "url"), keyed(t.withColumnRenamed("service", "service" if by_service else "found_service"), "template")
    met = u.join(t, ["method", "shape", "group", *own]).drop("group").distinct().withColumn("score", confidence(F.col("url"), F.col("template"))).where(F.col("score") >= least)
    return first_of(met, ["id"], F.desc("score"), "pos").select("id", "pos", "template", "score", *([] if by_service else ["found_service"]))


def merged_rules(rules: DataFrame) -> DataFrame:
    """rules(service, pos, pattern, http_method, source, priority, ...): one per pattern and method (none is ALL): the first of YAML, else the first of the highest priority; with its place, by priority, a rule for a method before one for all."""
    yaml = F.coalesce(F.col("source") == "yaml", F.lit(False))
    keyed = rules.withColumn("_m", F.coalesce("http_method", F.lit("ALL")))
    best = first_of(keyed, ["service", "pattern", "_m"], F.desc(yaml), F.when(~yaml, -F.col("priority")), "pos").drop("_m")
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("priority"), F.col("http_method").isNull(), "pattern", "pos"))
    return best.withColumn("place", place)


def coverage(scenarios: DataFrame, suggestions: DataFrame) -> DataFrame:
    """scenarios(method, uri), suggestions(endpoint: 'METHOD uri') -> total, matched, rate: suggestions that a scenario covers; rate 0 for none."""
    names = scenarios.select(F.concat_ws(" ", F.upper("method"), "uri").alias("endpoint")).distinct().withColumn("hit", F.lit(1))
    n = suggestions.join(names, "endpoint", "left").agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
    return n.select("total", "matched", F.round(F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)), 4).alias("rate"))


def wanted(endpoints: DataFrame, suggested: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """endpoints(id, service, controller, method) whose `service.controller.method` is suggested(name), and whose service is affected(service) where that is given; with the name of their scenario."""
    kept = endpoints.withColumn("name", F.concat_ws(".", "service", "controller", "method")).join(suggested.select("name").distinct(), "name", "left_semi")
    if affected is not None:
        kept = kept.join(affected.select("service").distinct(), "service", "left_semi")
    return kept.withColumn("scenario", F.concat(F.lit("scn_"), F.col("id")))


def searched(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose column holds any of the terms, case aside; all rows without a term."""
    said = [t.lower() for t in terms if t.strip()]
    return rows.where(F.exists(F.array(*map(F.lit, said)), lambda t: F.lower(column).contains(t))) if said else rows


#: Kinds of classes, in the order in which a name is looked up.
BUCKETS = ("controllers", "services", "repositories", "entities", "feignClients", "unknowns")


def looked_up(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """wanted(service, name), classes(service, bucket, pos, name, kind) -> the class meant: of that simple name or with Impl behind it, an interface only where there is no other, then by bucket and position."""
    simple = F.element_at(F.split("name", r"\."), -1)
    names = wanted.distinct().select("service", F.col("name").alias("wanted"), F.explode(F.array(simple, F.concat(simple, F.lit("Impl")))).alias("name"))
    met = names.join(classes, ["service", "name"])
    return first_of(met, ["service", "wanted"], F.col("kind") == "JInterface", F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")), "pos", "name").select("service", "wanted", "name", "bucket")


def injected(fields: DataFrame, beans: DataFrame) -> DataFrame:
    """fields(field, type, qualifier), beans(type, pos, bean, primary, name) -> field, how, bean.

    A field with a qualifier gets the first bean of its type and that name (QUALIFIER) or none (UNRESOLVED). Without one it
    gets the only bean of its type (EXACT), else the first primary one (PRIMARY), else none (AMBIGUOUS; UNRESOLVED without beans).
    What a type has to offer is worked out once for each type, so that a type of many fields or beans is no pair of many rows.
    """
    of_type = beans.groupBy("type").agg(F.count("*").alias("n"), F.min_by("bean", "pos").alias("one"), F.min_by("bean", F.when(F.col("primary"), F.col("pos"))).alias("first"))
    named = beans.where("name is not null").groupBy("type", F.col("name").alias("qualifier")).agg(F.min_by("bean", "pos").alias("named"))
    met = fields.select("field", "type", "qualifier").join(of_type, "type", "left").join(named, ["type", "qualifier"], "left")
    asked, n = F.col("qualifier").isNotNull(), F.coalesce("n", F.lit(0))
    how = F.when(asked & F.col("named").isNotNull(), "QUALIFIER").when(asked | (n == 0), "UNRESOLVED").when(n == 1, "EXACT").when(F.col("first").isNotNull(), "PRIMARY").otherwise("AMBIGUOUS")
    return met.select("field", how.alias("how"), F.when(asked, F.col("named")).when(n == 1, F.col("one")).otherwise(F.col("first")).alias("bean"))


# Words in a repository method's name, by precedence.
CREATES, READS, DELETES = "create|add|insert|save|update", "read|find|get|query", "delete|remove"


def operation_masks(calls: DataFrame) -> DataFrame:
    """calls(endpoint, http_method, repo, name) -> endpoint, repo, ops: bits 8 create (of a POST), 2 update (of any other), 4 read, 1 delete, by the first list of words that a call's name holds; calls of one repository are or-ed."""
    bits = F.when(F.col("name").rlike(CREATES), F.when(F.col("http_method") == "POST", 8).otherwise(2)).when(F.col("name").rlike(READS), 4).when(F.col("name").rlike(DELETES), 1).otherwise(0)
    return calls.select("endpoint", "repo", bits.alias("ops")).where("ops > 0").groupBy("endpoint", "repo").agg(F.bit_or("ops").alias("ops"))
