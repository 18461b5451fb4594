"""Texts that hold other texts: an inverted index of n-grams, and what is found that way.

A text can hold a needle only if it has each of the needle's n-grams. Needles are looked up by the one of their n-grams that
the fewest texts have, and what is met is compared in full, so that no text meets every needle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, needles: DataFrame, key: list[str] | None = None) -> DataFrame:
    """texts(key..., id, text), needles(key..., needle) -> key..., id, needle: the distinct pairs where the text holds the needle, letter by letter. Empty needles are held by none."""
    key = key or []
    wanted = needles.select(*key, "needle").where("needle != ''").distinct().withColumn("n", F.least(F.length("needle"), F.lit(GRAM)))
    sizes = [r["n"] for r in wanted.select("n").distinct().collect()]  # GRAM rows at most
    if not sizes:
        return texts.select(*key, "id", F.lit("").alias("needle")).where("false")
    index = texts.where("text is not null").select(*key, "id", F.explode(F.flatten(F.array(*(_grams(F.col("text"), n) for n in sizes)))).alias("gram"))
    often = index.groupBy(*key, "gram").agg(F.count("*").alias("texts"))
    parts = wanted.select(*key, "needle", F.explode(_grams(F.col("needle"), F.col("n"))).alias("gram")).join(often, [*key, "gram"], "left")
    rarest = parts.groupBy(*key, "needle").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("texts", F.lit(0))).alias("least")).where("least > 0")
    met = index.join(rarest.drop("least"), [*key, "gram"]).select(*key, "id", "needle").distinct()
    return met.join(texts.select(*key, "id", "text"), [*key, "id"]).where(F.contains("text", "needle")).select(*key, "id", "needle").distinct()


def component_of(services: DataFrame, components: DataFrame) -> DataFrame:
    """services(service), components(pos, id, name, microservice) -> service, pos, id: the first component whose name, id or microservice holds the service's name; null without one."""
    texts = components.select(F.col("pos").alias("id"), F.explode(F.array_compact(F.array("name", F.col("id").cast("string"), "microservice"))).alias("text"))
    texts = texts.select(F.struct("id", "text").alias("id"), "text").distinct()
    met = holding(texts, services.select(F.col("service").alias("needle"))).groupBy(F.col("needle").alias("service")).agg(F.min("id.id").alias("pos"))
    return services.select("service").distinct().join(met, "service", "left").join(components.select("pos", "id"), "pos", "left").select("service", "pos", "id")


def inferred_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """nodes(snapshot, name), calls(snapshot, src, signature), for snapshots without links -> snapshot, src, dst: a node whose call's signature holds another node's name calls that one."""
    texts = calls.select("snapshot", F.struct("src", "signature").alias("id"), F.col("signature").alias("text")).distinct()
    met = holding(texts, nodes.select("snapshot", F.col("name").alias("needle")), ["snapshot"])
    return met.select("snapshot", F.col("id.src").alias("src"), F.col("needle").alias("dst")).where("src != dst").distinct()


#: Roles that a mask can hold.
ROLES = 62
UNAUTHENTICATED = "UnauthenticatedRole"


def role_masks(endpoints: DataFrame, rules: DataFrame, files: DataFrame, initial: dict[int, str]) -> DataFrame:
    """endpoints(service, pos, method, url), rules(service, file, pos, kind, method, patterns, roles), files(service, file, authenticated), roles with a bit already -> service, pos, mask.

    Files are in order, and so are a file's rules and a rule's patterns; kind is hasRole, hasAnyRole or permitAll. A pattern that
    ends with `**` fits endpoints whose `METHOD url` holds what stands before it; `*` elsewhere stands for `{?}`. A rule for a
    method fits the first endpoint of that very name in any service, and with `**` those of its own service (hasRole: of all);
    a rule for all methods fits endpoints of its service that hold the pattern. The first rule that fits an endpoint sets its
    roles: its own, or for permitAll all that are known by then. At the end of its service's file an endpoint without roles
    gets all that are known, but for UNAUTHENTICATED where the file asks for authentication. Of rules with one pattern only the
    first counts and endpoints of one name share theirs, so that rows are in proportion to endpoints and rules. A role gets the next free bit when
    a hasRole rule names it, or a hasAnyRole rule that sets an endpoint's roles. Endpoints of services without a file keep 0.
    """
    e = endpoints.select("service", F.col("pos").alias("e_pos"), F.concat_ws(" ", "method", "url").alias("name"))
    r = rules.select("service", "file", F.col("pos").alias("rule"), "kind", "method", "roles", F.posexplode("patterns").alias("nth", "pattern"))
    open_ = F.col("pattern").endswith("**")
    plain = F.when(open_, F.regexp_replace(F.regexp_replace("pattern", r"\*", ""), "/+$", "")).otherwise(F.regexp_replace("pattern", r"\*", "{?}"))
    r = r.withColumns({"needle": F.when(F.col("method").isNotNull(), F.concat_ws(" ", "method", plain)).otherwise(plain), "how": F.when(F.col("method").isNotNull() & ~open_, "first").when(F.col("method").isNotNull() & (F.col("kind") == "hasRole"), "all").otherwise("own")})
    sets = F.min(F.struct(F.struct("file", "rule", "nth").alias("order"), "kind", "roles")).alias("x")
    first_rule = lambda how, *by: r.where(how).groupBy(*by).agg(sets)  # noqa: E731  # of rules that fit the same endpoints
    names = e.select("service", "name").distinct()
    named = names.select("service", F.col("name").alias("id"), F.col("name").alias("text"))
    own = holding(named, r.where("how = 'own'").select("service", "needle"), ["service"]).join(first_rule("how = 'own'", "service", "needle"), ["service", "needle"]).select("service", F.col("id").alias("name"), "x")
    every = names.join(first_rule("how = 'own' and needle = ''", "service"), "service").select("service", "name", "x")  # `/**` fits all
    anyone = holding(named.select("id", "text").distinct(), r.where("how = 'all'").select("needle")).join(first_rule("how = 'all'", "needle"), "needle").groupBy(F.col("id").alias("name")).agg(F.min("x").alias("any_x"))
    very = e.groupBy("name").agg(F.min("e_pos").alias("e_pos")).join(first_rule("how = 'first'", F.col("needle").alias("name")), "name").select("e_pos", F.col("x").alias("very_x"))
    ends = files.groupBy("service").agg(F.min_by(F.struct("file", "authenticated"), "file").alias("f")).select("service", "f.*")
    end = F.struct(F.struct("file", F.lit(2**31 - 1).alias("rule"), F.lit(0).alias("nth")).alias("order"), F.when(F.col("authenticated"), "authenticated").otherwise("all").alias("kind"), F.lit(None).cast("array<string>").alias("roles"))
    rest = names.join(ends, "service").select("service", "name", end.alias("x"))
    by_name = own.unionByName(every).unionByName(rest).groupBy("service", "name").agg(F.min("x").alias("x"))
    first = e.join(by_name, ["service", "name"], "left").join(anyone, "name", "left").join(very, "e_pos", "left").select("service", "e_pos", F.least("x", "any_x", "very_x").alias("x")).select("service", "e_pos", "x.*")
    asked = r.where("kind = 'hasRole'").select("file", "rule", "roles").distinct().unionByName(first.where("kind = 'hasAnyRole'").select("order.file", "order.rule", "roles").distinct())
    seen = asked.select("file", "rule", F.posexplode("roles").alias("at", "role")).groupBy("role").agg(F.min(F.struct("file", "rule", "at")).alias("first")).where(~F.col("role").isin(*initial.values()) if initial else F.lit(True))
    new = seen.orderBy("first").limit(ROLES + 1).collect()  # as many as a mask has bits
    free = [1 << k for k in range(ROLES + 1) if 1 << k not in initial]
    if len(new) + len(initial) > ROLES:
        raise ValueError(f"more than {ROLES} roles")
    known = [(-1, -1, role, bit) for bit, role in initial.items()] + [(x["first"]["file"], x["first"]["rule"], x["role"], bit) for x, bit in zip(new, free)]
    table = F.array(*(F.struct(F.lit(f).cast("long").alias("file"), F.lit(p).cast("long").alias("rule"), F.lit(n).alias("role"), F.lit(b).cast("long").alias("bit")) for f, p, n, b in known)) if known else F.array().cast("array<struct<file: long, rule: long, role: string, bit: long>>")
    before = lambda x: (x["file"] < F.col("order.file")) | ((x["file"] == F.col("order.file")) & (x["rule"] < F.col("order.rule")))
    bits = lambda keep: F.aggregate(F.filter(table, keep), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x["bit"]))
    kinds = F.when(F.col("kind").isin("hasRole", "hasAnyRole"), bits(lambda x: F.array_contains("roles", x["role"]))).when(F.col("kind") == "authenticated", bits(lambda x: before(x) & (x["role"] != UNAUTHENTICATED))).otherwise(bits(before))
    return first.select("service", F.col("e_pos").alias("pos"), F.when(F.col("order").isNull(), 0).otherwise(kinds).alias("mask"))
