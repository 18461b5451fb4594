"""Evidence per endpoint over the methods it reaches: reach(endpoint, method), the endpoint itself included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Annotations that say something about authorization, and which finding they stand for.
KNOWN = ("PreAuthorize", "PostAuthorize", "Secured", "RequiresAuthentication", "RequiresAdmin", "RolesAllowed", "DenyAll", "PermitAll", "DeclareRoles", "RunAs", "Validated", "CrossOrigin", "EnableWebSecurity")
POSITIVE = {
    "REQUIRES_ADMIN": ("RequiresAdmin", "PreAuthorize", "PostAuthorize"),
    "REQUIRES_AUTH": ("Secured", "RequiresAuthentication", "RolesAllowed", "DeclareRoles", "RunAs", "EnableWebSecurity"),
    "INPUT_VALIDATION": ("Valid", "Pattern", "CrossOrigin"),
}


def with_self(reach: DataFrame, endpoints: DataFrame) -> DataFrame:
    """reach(src, dst) and endpoints(endpoint) -> distinct (endpoint, method), each endpoint reaching itself."""
    own = endpoints.select("endpoint", F.col("endpoint").alias("method"))
    return reach.join(endpoints.select(F.col("endpoint").alias("src")), "src", "left_semi").select(F.col("src").alias("endpoint"), F.col("dst").alias("method")).union(own).distinct()


def auth_findings(endpoints: DataFrame, reach: DataFrame, annotations: DataFrame) -> DataFrame:
    """endpoints(endpoint, protection), annotations(method, name) -> endpoint, findings in fixed order: LDA where no known annotation is reached, what known ones stand for, UNPROTECTED_ENDPOINT for PUBLIC protection. Sets are tested while names are grouped, so nothing is gathered."""
    has = lambda names: F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))
    met = reach.join(annotations, "method").groupBy("endpoint").agg(has(KNOWN).alias("known"), *(has(names).alias(f) for f, names in POSITIVE.items()))
    rows = endpoints.select("endpoint", "protection").join(met, "endpoint", "left")
    flags = [(~F.coalesce("known", F.lit(False)), "LDA"), *((F.col(f), f) for f in POSITIVE), (F.col("protection") == "PUBLIC", "UNPROTECTED_ENDPOINT")]
    return rows.select("endpoint", F.array_compact(F.array(*(F.when(c, F.lit(f)) for c, f in flags))).alias("findings"))


def secret_flags(endpoints: DataFrame, findings: DataFrame) -> DataFrame:
    """endpoints(endpoint, service), findings(service, kind) -> the endpoints whose service has a hard-coded secret."""
    return endpoints.join(findings.where("kind = 'HardcodedSecret'").select("service"), "service", "left_semi").select("endpoint")


def sink_flags(reach: DataFrame, sinks: DataFrame) -> DataFrame:
    """sinks(method) -> the endpoints that reach one."""
    return reach.join(sinks.select("method").distinct(), "method", "left_semi").select("endpoint").distinct()


def complexity(reach: DataFrame, methods: DataFrame) -> DataFrame:
    """methods(method, cc) -> endpoint, complexity: the sum over the methods reached; 1 where it isn't known."""
    return reach.join(methods.select("method", "cc"), "method", "left").groupBy("endpoint").agg(F.sum(F.coalesce("cc", F.lit(1))).cast("long").alias("complexity"))


def shared_entities(endpoints: DataFrame, reach: DataFrame, accesses: DataFrame, owners: DataFrame) -> DataFrame:
    """endpoints(endpoint, service), accesses(method, entity), owners(method, service) -> endpoint, shared: entities on its path that another service accesses too.

    An entity is known by how many services access it and by one of them, so no two accesses of an entity meet.
    """
    of = accesses.join(owners, "method").groupBy("entity").agg(F.countDistinct("service").alias("n"), F.min("service").alias("one"))
    mine = reach.join(accesses, "method").select("endpoint", "entity").distinct().join(of, "entity")
    counted = endpoints.select("endpoint", "service").join(mine, "endpoint", "left")
    return counted.groupBy("endpoint").agg(F.count_if((F.col("n") > 1) | (F.col("one") != F.col("service"))).alias("shared"))


def access_counts(endpoints: DataFrame, reach: DataFrame, accesses: DataFrame) -> DataFrame:
    """accesses(method, ...), one row each -> endpoint, n: accesses from the methods reached, 0 for none."""
    each = accesses.groupBy("method").agg(F.count("*").alias("k"))
    return endpoints.select("endpoint").join(reach.join(each, "method"), "endpoint", "left").groupBy("endpoint").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
