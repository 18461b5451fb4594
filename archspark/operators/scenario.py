"""Test scenarios from permissions along call chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.text import sensitivity


def roles_or_default(roles: Column) -> Column:
    """Roles as they are, or ADMIN and USER where there are none."""
    return F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, roles).otherwise(F.array(F.lit("ADMIN"), F.lit("USER")))


def higher(role: Column, than: Column, roles: Column) -> Column:
    """Whether a role comes before another in the order of privilege; null where one is unknown."""
    at = lambda r: F.nullif(F.array_position(roles, r), F.lit(0))
    return at(role) < at(than)


def assembled(matrix: DataFrame, entries: DataFrame) -> DataFrame:
    """matrix(root, position, role, role_idx, v), entries(root, uri, max_depth, required, is_public) -> a scenario per root.

    Roles allowed: those the entry requires; else those allowed all along the chain; else those the entry's row allows. The
    rest is denied, and the expected status is 2xx or 403. An endpoint is Downstream where the chain goes deeper than 0.
    """
    per = matrix.groupBy("root", "role", "role_idx").agg((F.min("v") == 1).alias("throughout"), F.bool_or((F.col("position") == 0) & (F.col("v") == 1)).alias("at_entry"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("role_idx", "role")))), lambda x: x["role"])  # noqa: E731  (as many as there are roles)
    by = per.groupBy("root").agg(pick(F.lit(True)).alias("roles"), pick(F.col("throughout")).alias("chain"), pick(F.col("at_entry")).alias("entry"))
    rows = entries.join(by, "root")
    some = lambda c: F.when(F.size(c) > 0, c)
    allowed = F.coalesce(some(F.col("required")), some(F.col("chain")), F.col("entry"))
    rows = rows.withColumn("allowed", allowed)
    status = F.transform("roles", lambda r: F.concat(r, F.when(F.array_contains("allowed", r), F.lit("=2xx")).otherwise(F.lit("=403"))))
    kind = F.when(F.col("max_depth") > 0, "DownstreamPolicyConsistency").otherwise("EntryPointAuthorization")
    return rows.select("root", F.concat(F.lit("scn_"), F.col("root")).alias("scenario"), kind.alias("type"), "uri", "max_depth", "is_public", "allowed", F.array_except("roles", "allowed").alias("denied"), status.alias("status"))


def inferred(scenarios: DataFrame) -> DataFrame:
    """Adds sensitivity (by the URI), awareness and prompt type (deep chains are HIGH and want a chain of thought) and whether a public endpoint exposes something financial or personal."""
    deep = F.col("max_depth") > 0
    rows = scenarios.withColumn("sensitivity", sensitivity(F.col("uri"), transactions=False))
    return rows.select("*", F.when(deep, "HIGH").otherwise("LOW").alias("awareness"), F.when(deep, "CHAIN_OF_THOUGHT").otherwise("SIMPLE").alias("prompt_type"), (F.col("is_public") & F.col("sensitivity").isin("FINANCIAL", "PII")).alias("exposed"))


def template(kind: Column, category: Column, awareness: Column) -> Column:
    """Prompt template of a scenario. CONSISTENT is looked for anywhere in the category, INCONSISTENT included, as the label has it."""
    unset = F.coalesce(category, F.lit("UNSET")) == "UNSET"
    entry = F.when(category.contains("POLICY_EXPOSURE"), "entrypoint_public_sensitive").otherwise("entrypoint_status_matrix")
    deep = F.when(category.contains("CONSISTENT"), "downstream_consistent_path").when(awareness == "HIGH", "downstream_inconsistency_cot").otherwise("downstream_inconsistency_simple")
    return F.when(unset, "generic_authorization").when(kind == "EntryPointAuthorization", entry).otherwise(deep)
