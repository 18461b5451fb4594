"""Permission operators. Roles are an array in order of privilege, highest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_access(role: Column, required: Column, roles: list[str]) -> Column:
    """1 allowed, 0 denied, -1 unknown. Required null: -1, empty: 1; a role or requirement that isn't known: -1; else allowed at the privilege of the lowest required role or above."""
    order = F.array(*(F.lit(r) for r in roles))
    at = F.array_position(order, role)
    base = F.array_max(F.filter(F.transform(required, lambda r: F.array_position(order, r)), lambda p: p > 0))
    known = F.when(at <= base, 1).otherwise(0)
    return F.when(required.isNull(), -1).when(F.size(required) == 0, 1).when((at == 0) | base.isNull(), -1).otherwise(known)


def permission_matrix(chain: DataFrame, roles: list[str]) -> DataFrame:
    """chain(root, position, endpoint, required) -> a row per role: v in 1, 0, -1."""
    each = chain.select("*", F.posexplode(F.array(*(F.lit(r) for r in roles))).alias("role_idx", "role"))
    return each.select("root", "position", "endpoint", "role", "role_idx", check_access(F.col("role"), F.col("required"), roles).alias("v"))


def pair_findings(matrix: DataFrame) -> DataFrame:
    """Findings between consecutive endpoints of a chain, per role."""
    by = Window.partitionBy("root", "role").orderBy("position")
    up, v = F.lag("v").over(by), F.col("v")
    found = matrix.select("root", "role", "position", up.alias("up"), v.alias("v"))
    kind = F.when(F.col("up") == v, None).when((F.col("up") == -1) | (v == -1), "UndefinedPolicy").when((F.col("up") == 1) & (v == 0), "UnderPermissiveDownstream").when((F.col("up") == 0) & (v == 1), "OverPermissiveDownstream")
    return found.where("up is not null").select("root", "role", "position", kind.alias("finding")).where("finding is not null")


def restrictive_upstream(chain: DataFrame) -> DataFrame:
    """Roles that a later endpoint requires but the entry doesn't; nothing where either names no role."""
    entry = chain.where("position = 0 and size(required) > 0").select("root", F.col("required").alias("at_entry"))
    later = chain.where("position > 0 and size(required) > 0").join(entry, "root")
    return later.select("root", F.explode(F.array_except("required", "at_entry")).alias("role"), F.col("endpoint").alias("downstream")).distinct()


def summary(matrix: DataFrame) -> DataFrame:
    """Per endpoint of a root: roles allowed, denied and unknown, all-unknown flag, and the share of grants."""
    pick = lambda v: F.array_join(F.array_sort(F.collect_set(F.when(F.col("v") == v, F.col("role")))), ",")
    n = lambda v: F.count_if(F.col("v") == v)
    return matrix.groupBy("root", "endpoint").agg(pick(1).alias("allowed"), pick(0).alias("denied"), pick(-1).alias("unknown"), (n(-1) == F.count("*")).alias("is_public"), F.round(n(1) / F.count("*"), 4).alias("grant_rate"))


def allowed_throughout(matrix: DataFrame) -> DataFrame:
    """Roles allowed at every endpoint of a chain."""
    return matrix.groupBy("root", "role").agg(F.min("v").alias("least")).where("least = 1").select("root", "role")


def category(scenarios: DataFrame, findings: DataFrame) -> DataFrame:
    """scenarios(root, max_depth, sensitivity, is_public), findings(root, finding) -> root, category: BASE_INCONSISTENCY_SENSITIVITY_EXPOSURE.

    The inconsistency is that of the finding that matters most: an exposure of a public endpoint, then too much allowed
    downstream, then too little, then an undefined policy, then any other.
    """
    has = lambda name: F.bool_or(F.col("finding") == name).alias(name)
    kinds = ("PolicyExposure", "OverPermissiveDownstream", "UnderPermissiveDownstream", "UndefinedPolicy")
    found = findings.groupBy("root").agg(*map(has, kinds), F.count("finding").alias("n"))
    base = F.when(F.col("max_depth") > 0, "DOWNSTREAM").otherwise("ENTRYPOINT")
    exposed, over, under, undefined = (F.col(k) for k in kinds)
    part = F.when(F.coalesce("n", F.lit(0)) == 0, "CONSISTENT").when(exposed & F.col("is_public"), "POLICY_EXPOSURE").when(over, "OVER_PERMISSIVE").when(under, "UNDER_PERMISSIVE").when(undefined, "UNDEFINED_POLICY").otherwise("ROLE_MISMATCH")
    exposure = F.when(F.col("is_public"), "PUBLIC").otherwise("RESTRICTED")
    return scenarios.join(found, "root", "left").select("root", F.concat_ws("_", base, part, F.coalesce("sensitivity", F.lit("UNKNOWN")), exposure).alias("category"))


def violations(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """endpoints(name, mask), links(caller, callee): masks that are 0, and callers whose roles the callee doesn't all admit."""
    empty = endpoints.where("mask = 0").select(F.col("name").alias("a"), F.lit(None).cast(endpoints.schema["name"].dataType).alias("b"), F.lit("no_role").alias("rule"))
    a, b = (endpoints.select(F.col("name").alias(x), F.col("mask").alias(f"m{x}")) for x in "ab")
    wider = links.select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct().join(a, "a").join(b, "b").where("(ma & ~mb) != 0")
    return empty.unionByName(wider.select("a", "b", F.lit("caller_not_in_callee").alias("rule")))


# Labels of role masks; bits are 1 unauthenticated, 2 user, 4 admin.
ROLE_LABELS = {0: "None", 1: "Unauthenticated", 2: "User Only", 4: "Admin Only", 6: "User + Admin Only", 7: "Any Authenticated User"}


def role_label(mask: Column) -> Column:
    """Label of a role mask; a mask without one is its number."""
    label = F.coalesce(*(F.when(mask == m, F.lit(x)) for m, x in ROLE_LABELS.items()))
    return F.coalesce(label, mask.cast("string"))


def inconsistent_touches(endpoints: DataFrame, touches: DataFrame, links: DataFrame, roles: list[int]) -> DataFrame:
    """Rows (role, repo, e1, e2) that break the data consistency rule.

    endpoints(name, mask), touches(endpoint, repo, ops), links(caller, callee). A role that may call e1, which does to a
    repository all that e2 does to it, should be allowed to call e2; unless an endpoint that e2 calls denies the role, or e1
    doesn't do to another repository of both all that e2 does. Endpoints of one repository meet once for all roles, held as
    bits. What excuses a pair is the same for each of its repositories and roles: it is a meeting of the pair on any repository
    where e1 doesn't do all that e2 does, so that meetings are compared by pair and never with all that both touch.
    """
    bits = lambda keep: sum((F.when(keep(r), 1 << k).otherwise(0) for k, r in enumerate(roles)), F.lit(0))
    may = bits(lambda r: F.col("mask").bitwiseAND(r) > 0)
    barred = bits(lambda r: (F.col("mask").bitwiseAND(r) > 0) | F.col("m").bitwiseAND(r).eqNullSafe(0))
    known = endpoints.where("mask is not null").select(F.col("name").alias("endpoint"), "mask")
    deeper = links.select("caller", "callee").distinct().join(endpoints.select(F.col("name").alias("callee"), F.col("mask").alias("m")), "callee").select(F.col("caller").alias("endpoint"), "m")
    known = known.join(deeper, "endpoint", "left").groupBy("endpoint", "mask").agg(F.bit_or(may).alias("may"), F.bit_or(barred).alias("barred"))
    t = touches.groupBy("endpoint", "repo").agg(F.bit_or("ops").alias("ops")).join(known, "endpoint")
    a = t.where("may != 0").select("repo", F.col("endpoint").alias("e1"), F.col("ops").alias("ops1"), "may")
    b = t.select("repo", F.col("endpoint").alias("e2"), F.col("ops").alias("ops2"), F.lit((1 << len(roles)) - 1).bitwiseAND(F.bitwise_not("barred")).alias("open")).where("open != 0")
    met = a.join(b, "repo").select("e1", "e2", "repo", F.col("may").bitwiseAND(F.col("open")).alias("bits"), (F.col("ops1").bitwiseAND(F.col("ops2")) == F.col("ops2")).alias("all")).where("bits != 0")
    broken = met.where("all").select("e1", "e2", "repo", "bits").join(met.where("not all").select("e1", "e2"), ["e1", "e2"], "left_anti")
    of = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << k) > 0, F.lit(r)) for k, r in enumerate(roles))))
    return broken.select(F.explode(of).alias("role"), "repo", "e1", "e2")


def role_order(endpoints: DataFrame, priorities: DataFrame, other: int = 999) -> DataFrame:
    """endpoints(required: roles), priorities(role, priority) -> role, idx: the roles that any endpoint requires, by priority (`other` for roles without one), then by name. A system's roles are few: they are ordered in one task."""
    roles = endpoints.select(F.explode("required").alias("role")).where("role is not null").distinct().join(priorities.dropDuplicates(["role"]), "role", "left")
    return roles.select("role", (F.row_number().over(Window.orderBy(F.coalesce("priority", F.lit(other)), "role")) - 1).alias("idx"))


# Mechanisms that work by token, and names of filters that look at one.
TOKENS, FILTERS = ("JWT", "OAUTH2", "API_KEY"), "JWT|Token|Auth"


def optional_authentication(endpoints: DataFrame, mechanisms: DataFrame, filters: DataFrame) -> DataFrame:
    """endpoints(id, service, required, permit_all), mechanisms(service, type), filters(service, name) -> endpoints with optional: public ones of a service that works by token and has a filter for tokens."""
    by_token = mechanisms.where(F.col("type").isin(*TOKENS)).select("service").distinct()
    looked_at = filters.where(F.col("name").rlike(FILTERS)).select("service").distinct().join(by_token, "service", "left_semi").withColumn("_token", F.lit(True))
    public = ~F.coalesce("required", F.lit(False)) | F.coalesce("permit_all", F.lit(False))
    return endpoints.join(looked_at, "service", "left").withColumn("optional", public & F.coalesce("_token", F.lit(False))).drop("_token")


def call_sites(methods: DataFrame, nested: DataFrame, in_class: DataFrame, endpoints_only: bool = False) -> DataFrame:
    """methods(class, method), nested(class, method, pos, called_from, type), in_class(class, pos, called_from, type) -> class, method, level, pos: the calls made from a method: those listed with it (`method`), or where none of them is its own, its class's (`class`).

    A call is made from a method whose name it gives, alone or after `&`, `#` or `.`: what it gives is looked up by equality, once for each end that begins behind such a sign.
    """
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.length("called_from")), lambda i: F.when(F.substring("called_from", i, F.lit(1)).isin("&", "#", "."), F.substring("called_from", i + 1, F.length("called_from")))), lambda s: s.isNotNull())
    name = F.explode(F.array_distinct(F.concat(F.array("called_from"), ends)))
    kept = lambda df: df.where("called_from != ''" + (" and type = 'Endpoint'" if endpoints_only else ""))
    own = kept(nested).select("class", F.col("method").alias("listed"), "pos", name.alias("method")).where("method = listed").drop("listed")
    own = own.join(methods.select("class", "method").distinct(), ["class", "method"], "left_semi").withColumn("level", F.lit("method"))
    rest = methods.select("class", "method").distinct().join(own, ["class", "method"], "left_anti")
    shared = kept(in_class).select("class", "pos", name.alias("method")).join(rest, ["class", "method"]).withColumn("level", F.lit("class"))
    return own.unionByName(shared).select("class", "method", "level", "pos")
