"""Operators on the details of an IR bound to the tables of a folder: features, schemas, prompt contexts, guardrails, statuses, variables, lookups, local calls, structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from archspark.operators import answers, features, graph, risk
from archspark.plans.bindings import _t, query
from archspark.plans.more import _METHODS, _ir
from archspark.sources import ir as IR

_KEYS = ("userName", "serviceName", "amountDue", "orderStatus", "maxLimit", "isActive", "plain", "uuid")


@query("""WITH d AS (SELECT p_partkey AS id, ['userName', 'serviceName', 'amountDue', 'orderStatus', 'maxLimit', 'isActive', 'plain', 'uuid'][p_size % 8 + 1] AS k, p_partkey % 2 = 0 AS b, p_partkey % 3 = 0 AS t, p_partkey % 5 = 0 AS a FROM part)
  SELECT id, k IN ('userName', 'uuid') OR t OR a AS has_pii, concat_ws(';', CASE WHEN k IN ('userName', 'uuid') THEN 'field: ' || k END, CASE WHEN t THEN 'type: EmailField' END, CASE WHEN a THEN 'annotation: @Mask(x)' END) AS evidence,
    concat_ws(';', CASE k WHEN 'amountDue' THEN k || ' > 0 required' WHEN 'orderStatus' THEN k || ' must be valid business status' WHEN 'maxLimit' THEN k || ' must be within defined range' END, CASE WHEN b THEN k || ' must be True to pass validation' END) AS hints FROM d""")
def f1_ir_features(spark, sf):
    """Parts are nodes of one field, with a type and annotations."""
    p, k = _t(spark, sf, "part"), F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, _KEYS)), F.col("p_size") % 8)
    doc = F.concat(F.lit('{"'), name, F.lit('": '), F.when(k % 2 == 0, "true").otherwise('"true"'), F.lit(', "type": "'), F.when(k % 3 == 0, "EmailField").otherwise("x"), F.lit('", "annotations": ['), F.when(k % 5 == 0, '"@Mask(x)"').otherwise(""), F.lit("]}"))
    found = features.ir_features(p.select(k.alias("id"), doc.alias("doc")))
    return found.select("id", "has_pii", F.array_join("evidence", ";").alias("evidence"), F.array_join("hints", ";").alias("hints"))


@query("""WITH s AS (SELECT p_brand AS id, CASE WHEN min(p_partkey) % 2 = 0 THEN '' ELSE '1' END AS service FROM part GROUP BY 1), a AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)
  SELECT id, CAST(count(*) AS INTEGER) AS n_fields, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_annotations FROM s JOIN part ON p_brand = id AND (service = '' OR p_partkey % 4 = 1) LEFT JOIN a ON l_partkey = p_partkey GROUP BY id""")
def f1_entity_schemas(spark, sf):
    """Brands are entity classes, their parts fields, flags of returned lineitems annotations."""
    p = _t(spark, sf, "part")
    fields = p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("class"), F.concat(F.lit("ts-"), F.col("p_partkey") % 4).alias("microservice"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.col("p_type").alias("type"))
    s = p.groupBy(F.col("p_brand").alias("id")).agg(F.when(F.min("p_partkey") % 2 == 0, "").otherwise("1").alias("service")).withColumn("entity", F.col("id"))
    marks = _t(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    a = marks.select(F.col("l_orderkey").alias("pos"), F.col("p_brand").alias("class"), F.concat(F.lit("x#field:instance#field:f"), "p_partkey", F.lit(":y")).alias("full_id"), F.lit("Column").alias("name"), F.create_map(F.lit("flag"), "l_returnflag").alias("attributes"))
    n = F.aggregate("fields", F.lit(0).cast("long"), lambda acc, f: acc + F.size(f["annotations"]))
    return features.entity_schemas(s, fields, a).select("id", F.size("fields").alias("n_fields"), n.alias("n_annotations"))


_PROMPTED = """WITH s AS (SELECT *, c_custkey % 6 AS t, CASE WHEN c_custkey % 4 > 0 THEN 'PII' END AS sens FROM customer)
  SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 4 ELSE 3 END AS INTEGER) AS n_goals, 'SIMPLE' AS prompt_type, coalesce(sens, 'UNKNOWN') AS sensitivity, 'UNSET' AS category, ['entrypoint_status_matrix', 'entrypoint_public_sensitive', 'downstream_consistent_path', 'downstream_inconsistency_cot', 'downstream_inconsistency_simple', 'generic_authorization'][t + 1] AS template,
    '{"scenario_id":' || c_custkey || CASE WHEN t < 2 THEN ',"endpoint":"' || c_name || '","method":null,"service_name":"s"' ELSE ',"service_name":"s","endpoint":"' || c_name || '","method":null' END ||
    CASE t WHEN 0 THEN ',"allowed_roles":["ADMIN"],"denied_roles":[],"expected_status_by_role":{}' WHEN 1 THEN ',"sensitivity_type":' || coalesce('"' || sens || '"', 'null') || ',"authorization":{},"policy_inconsistencies":[]' WHEN 2 THEN ',"max_depth":2,"total_calls":0,"allowed_roles":["ADMIN"]'
    WHEN 5 THEN ',"type":"' || CASE WHEN c_custkey % 2 = 0 THEN 'EntryPointAuthorization' ELSE 'DownstreamPolicyConsistency' END || '"' ELSE ',"max_depth":2,"total_calls":0,"policy_inconsistencies":[],"policy_inconsistency_roles":[]' END || '}' AS parameters FROM s"""


@query(_PROMPTED)
def f1_prompt_contexts(spark, sf):
    """Customers are scenarios; some of the parameters are missing, by column or by null."""
    k = F.col("c_custkey")
    templates = F.array(*map(F.lit, (*features.PARAMETERS, None)))
    s = _t(spark, sf, "customer").select(k.alias("scenario_id"), F.lit("s").alias("service_name"), F.col("c_name").alias("endpoint"), F.lit(None).cast("string").alias("method"), F.when(k % 2 == 0, "EntryPointAuthorization").otherwise("DownstreamPolicyConsistency").alias("type"), F.when(k % 3 == 0, "HIGH").otherwise("LOW").alias("awareness"), F.get(templates, (k % 6).cast("int")).alias("template"), F.array(F.lit("ADMIN")).alias("allowed_roles"), F.when(k % 4 > 0, "PII").alias("sensitivity_type"), F.lit(2).alias("max_depth"))
    c = F.col("prompt_context")
    return features.prompt_contexts(s).select(F.col("scenario_id").alias("id"), F.size(c["goals"]).alias("n_goals"), c["prompt_type"].alias("prompt_type"), c["sensitivity"].alias("sensitivity"), c["scenario_category"].alias("category"), c["template_id"].alias("template"), c["parameters"].alias("parameters"))


_ASKED = """SELECT conv_id * 100 + turn AS id, ['ARCHITECTURE_TOPOLOGY', 'DEPENDENCY', 'ENDPOINT_LOOKUP', 'GENERAL'][turn % 4 + 1] AS intent, CASE WHEN turn % 5 = 0 THEN [] WHEN turn % 5 < 3 THEN ['IR', 'TEST'] ELSE ['GRAPH'] END AS kinds, turn % 7 = 0 AS missed FROM conversations"""


@query(f"""WITH a AS ({_ASKED}), m AS (SELECT *, intent <> 'GENERAL' AS g, list_filter(CASE intent WHEN 'ARCHITECTURE_TOPOLOGY' THEN ['IR', 'ARCHITECTURE', 'GRAPH'] WHEN 'DEPENDENCY' THEN ['GRAPH', 'DEPENDENCY'] WHEN 'ENDPOINT_LOOKUP' THEN ['IR', 'ENDPOINT'] ELSE [] END, lambda k: NOT list_contains(kinds, k)) AS lacks,
    CASE intent WHEN 'ARCHITECTURE_TOPOLOGY' THEN 3 ELSE 2 END AS n FROM a)
  SELECT id, g AND (len(kinds) = 0 OR len(lacks) = n) AS blocked, CASE WHEN g AND (len(kinds) = 0 OR len(lacks) = n) THEN 'INSUFFICIENT_EVIDENCE' WHEN g AND (len(lacks) > 0 OR missed) THEN 'PARTIAL' END AS flag,
    CASE WHEN g THEN concat_ws(',', CASE WHEN missed THEN 'commit' END, CASE WHEN len(lacks) > 0 THEN array_to_string(list_transform(lacks, lambda k: CASE k WHEN 'IR' THEN 'IR' WHEN 'GRAPH' THEN 'graph' WHEN 'ARCHITECTURE' THEN 'component index' WHEN 'ENDPOINT' THEN 'endpoint data' ELSE lower(k) END), ',') END) ELSE '' END AS missing_sources FROM m""")
def c1_before_generation(spark, sf):
    """Turns of conversations ask with evidence of some kinds."""
    turn = F.col("turn")
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    intents = arr("ARCHITECTURE_TOPOLOGY", "DEPENDENCY", "ENDPOINT_LOOKUP", "GENERAL")
    kinds = F.when(turn % 5 == 0, arr()).when(turn % 5 < 3, arr("IR", "TEST")).otherwise(arr("GRAPH"))
    asked = _t(spark, sf, "conversations").select((F.col("conv_id") * 100 + turn).alias("id"), F.lit("hello").alias("question"), F.get(intents, (turn % 4).cast("int")).alias("intent"), kinds.alias("kinds"), arr().alias("origins"), F.when(turn % 7 == 0, arr("COMMIT")).otherwise(arr()).alias("missing"), F.lit(False).alias("no_context"))
    return answers.before_generation(asked).select("id", "blocked", "flag", F.array_join("missing_sources", ",").alias("missing_sources"))


@query("""SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 4 = 0 THEN 'Insufficient citation support: generated answer did not include valid evidence citations.' WHEN turn % 4 = 1 THEN 'Insufficient citation support: no valid citations remain after validation.'
    WHEN turn % 4 = 2 THEN 'as [E1] and [citation_removed] say' ELSE 'as [E1] and [E2] say' END AS answer, CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS n_citations,
  CASE turn % 4 WHEN 0 THEN 'CITATION_VALIDATION_FAILED,INSUFFICIENT_EVIDENCE' WHEN 1 THEN 'CITATION_VALIDATION_FAILED,INSUFFICIENT_EVIDENCE' WHEN 2 THEN 'CITATION_VALIDATION_FAILED' ELSE '' END AS flags, CASE turn % 4 WHEN 2 THEN 'LOW' WHEN 3 THEN NULL ELSE 'INSUFFICIENT_EVIDENCE' END AS confidence FROM conversations""")
def c1_after_generation(spark, sf):
    """Turns answer with citations that exist or not."""
    turn = F.col("turn")
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cited = F.when(turn % 4 == 0, arr()).when(turn % 4 == 1, arr("z")).when(turn % 4 == 2, arr("a", "z")).otherwise(arr("a", "b"))
    n = F.when(turn % 4 == 2, arr("a")).otherwise(arr("a", "b"))
    rows = _t(spark, sf, "conversations").select((F.col("conv_id") * 100 + turn).alias("id"), F.lit("which services depend?").alias("question"), F.lit("DEPENDENCY").alias("intent"), F.lit("as [E1] and [E2] say").alias("answer"), cited.alias("citations"), n.alias("artifacts"), arr("GRAPH").alias("kinds"), arr().alias("origins"))
    return answers.after_generation(rows).select("id", "answer", F.size("citations").alias("n_citations"), F.array_join("flags", ",").alias("flags"), "confidence")


@query("""WITH t AS (SELECT p_partkey AS id, p_size % 4 AS k, p_partkey % 3 AS a, p_partkey % 2 = 0 AS r FROM part)
  SELECT id, ['200=Order,404=void', '200=List<Order>', '200=Order,404=void', '200=Order'][k + 1] || CASE WHEN a < 2 THEN ',401=ErrorResponse' ELSE '' END || CASE WHEN a = 0 AND r THEN ',403=ErrorResponse' ELSE '' END AS statuses FROM t""")
def f1_statuses(spark, sf):
    """Parts are endpoints of four return types."""
    k = F.col("p_partkey")
    types = F.array(*map(F.lit, ("ResponseEntity<Optional<Order>>", "ResponseEntity<List<Order>>", "Optional<Order>", "Page<Order>")))
    roles = F.when(k % 2 == 0, F.array(F.lit("ADMIN")))
    m = features.statuses(F.get(types, F.col("p_size") % 4), k % 3 == 0, k % 3 == 1, roles)
    return _t(spark, sf, "part").select(k.alias("id"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("statuses"))


@query("""WITH s AS (SELECT p_brand AS method, 'v' || p_size % 3 AS variable, 'defines' AS kind, p_partkey AS id FROM part UNION ALL SELECT p_brand, unnest(['v' || p_size % 4, 'w']), 'uses', p_partkey FROM part)
  SELECT method, variable, kind, string_agg(id, ',' ORDER BY id) AS nodes FROM s GROUP BY method, variable, kind""")
def f1_variable_sites(spark, sf):
    """Brands are methods, their parts nodes."""
    v = lambda k: F.concat(F.lit("v"), F.col("p_size") % k)
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("method"), F.col("p_partkey").alias("id"), F.array(v(3)).alias("defines"), F.array(v(4), F.lit("w")).alias("uses"))
    return features.variable_sites(p).select("method", "variable", "kind", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query("""WITH w AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS name FROM part) SELECT name, coalesce((SELECT min(s_suppkey) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = name), (SELECT min(s_suppkey) FROM supplier WHERE CAST(s_nationkey AS VARCHAR) = name)) AS value,
  CASE WHEN (SELECT min(s_suppkey) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = name) IS NOT NULL THEN 's_suppkey' WHEN (SELECT min(s_suppkey) FROM supplier WHERE CAST(s_nationkey AS VARCHAR) = name) IS NOT NULL THEN 's_nationkey' END AS key FROM w""")
def n1_found_by(spark, sf):
    """Sizes looked up as keys of suppliers, then of their nations."""
    rows = _t(spark, sf, "supplier").withColumn("pos", F.col("s_suppkey"))
    return features.found_by(_t(spark, sf, "part").select(F.col("p_size").alias("name")), rows, ["s_suppkey", "s_nationkey"], "s_suppkey")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS root, p_partkey AS method, 0 AS depth FROM part UNION ALL SELECT root, p_partkey, depth + 1 FROM r JOIN part ON p_partkey = method // 10 WHERE method >= 10)
  SELECT root, CAST(count_if(p_size % 5 = 0) AS BIGINT) AS n_remote, CAST(max(depth) AS BIGINT) AS local_methods, max(depth) AS max_local_depth, CAST(coalesce(sum(depth) FILTER (p_size % 5 = 0), 0) AS BIGINT) AS nested FROM r JOIN part ON method = p_partkey GROUP BY root""")
def g3_local_descent(spark, sf):
    """Parts call the part of a tenth of their number; those of a size that five divides call another service."""
    p = _t(spark, sf, "part")
    local = p.where("p_partkey >= 10").select(F.col("p_partkey").alias("src"), F.lit(1).alias("pos"), F.expr("p_partkey div 10").alias("dst")).join(p.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "pos", "dst")
    remote = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("method"), F.lit(0).alias("pos"), F.lit("other").alias("target"))
    rows, counts = graph.local_descent(local, remote, p.select(F.col("p_partkey").alias("id")))
    return counts


@query("""WITH b AS (SELECT p_partkey AS key, p_size % 5 / 10 AS b, p_size % 3 / 10 AS d, CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 1 - p_size % 5 / 10 - p_size % 3 / 10 END AS u FROM part) SELECT key, b + d + u > 0.999 AND b + d + u < 1.001 AS valid FROM b""")
def r2_calibrated(spark, sf):
    """Opinions of parts, a quarter of them with an uncertainty that needn't fit."""
    b, d = F.col("p_size") % 5 / 10, F.col("p_size") % 3 / 10
    o = _t(spark, sf, "part").select(F.col("p_partkey").alias("key"), b.alias("b"), d.alias("d"), F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(1 - b - d).alias("u"))
    return risk.calibrated(o).select("key", "valid")


@query(f"""WITH m AS ({_METHODS}), c AS (SELECT DISTINCT system, service, class FROM m)
  SELECT system, service AS src, service || '.' || class AS dst, 'hierarchy' AS kind FROM c UNION ALL SELECT system, service || '.' || class, service || '.' || class || '.' || method, 'hierarchy' FROM m""")
def i1_structural_edges(spark, sf):
    """Services hold classes, and these hold methods."""
    return IR.structural_edges(_ir(spark, sf))
