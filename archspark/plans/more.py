"""More operators bound to the tables of a folder: an IR made of suppliers and nations, evidence over parts that call parts, joins by name, scenarios, censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.functions import text as X
from archspark.operators import answers, census, enrich, graph, scenario, store, symbolic
from archspark.plans.bindings import _CHAIN, _MATRIX, _chain, _t, p1_permission_matrix, query
from archspark.sources import ir as IR

# --- an IR of each region: nations are services, suppliers their controllers (odd numbers) or service classes, with one to three methods
_METHODS = """SELECT r_name AS system, n_name AS service, CASE WHEN s_suppkey % 2 = 1 THEN 'Controller' ELSE 'Service' END AS role, s_suppkey, s_name AS class, CAST(k - 1 AS INTEGER) AS pos, CAST(s_suppkey * 10 + k AS VARCHAR) AS method_id, 'm' || k AS method,
  CASE WHEN k < 3 AND s_suppkey % 2 = 1 THEN CASE WHEN k = 1 THEN 'get' ELSE 'POST' END END AS http_method, CASE WHEN k < 3 AND s_suppkey % 2 = 1 THEN '/api/' || n_name || '/' || s_suppkey || '/' || k END AS url
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= s_suppkey % 3 + 1"""


def _ir(spark, sf) -> DataFrame:
    """Nested documents, built by grouping upwards."""
    s = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    odd, key = F.col("s_suppkey") % 2 == 1, F.col("s_suppkey")
    given = lambda k, v: F.when((k < 3) & odd, v)
    call = lambda k: F.struct(F.lit("c").alias("id"), F.concat(F.lit("m"), k).alias("name"), F.lit("").alias("objectType"), F.lit("x").alias("type"))
    url = lambda k: F.concat(F.lit("api//"), F.col("n_name"), F.lit("/"), key, F.lit("/"), k, F.lit("/"))
    method = lambda k: F.struct((key * 10 + k).cast("string").alias("id"), F.concat(F.lit("m"), k).alias("name"), given(k, F.when(k == 1, "get").otherwise("POST")).alias("httpMethod"), given(k, url(k)).alias("url"), F.array(call(F.lit(1))).alias("methodCalls"))
    klass = F.struct(F.col("s_suppkey"), F.struct(key.cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("p").alias("path"), F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), method).alias("methods")).alias("c"))
    group = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, klass))), lambda x: x["c"])
    nations = s.groupBy("r_name", "n_nationkey", "n_name").agg(group(odd).alias("controllers"), group(~odd).alias("services"))
    service = F.struct("n_nationkey", F.struct(F.col("n_name").alias("name"), F.lit("src").alias("path"), "controllers", "services").alias("s"))
    docs = nations.groupBy(F.col("r_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(service)), lambda x: x["s"]).alias("microservices"))
    return docs.select(F.from_json(F.to_json(F.struct("name", "microservices")), IR.IR).alias("d")).select("d.*")


@query(f"SELECT system, service, role, class, pos, method_id, method, http_method, url FROM ({_METHODS})")
def i1_methods(spark, sf):
    return IR.methods(_ir(spark, sf)).select("system", "service", "role", "class", "pos", "method_id", "method", "http_method", "url")


@query(f"SELECT system, method_id, service || '.' || class || '.' || method || CASE role WHEN 'Controller' THEN '_' ELSE '._' END || pos AS \"unique\" FROM ({_METHODS})")
def i1_view_names(spark, sf):
    return IR.view_names(_ir(spark, sf))


@query(f"""WITH m AS ({_METHODS}), s AS (SELECT r_name AS system, n_name AS service, n_nationkey AS p, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 2 = 1) AS INTEGER) AS c, CAST((SELECT count(*) FROM m WHERE m.service = n_name AND url IS NOT NULL) AS INTEGER) AS e
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)),
  rows AS (SELECT system, p, -1 AS k, -1 AS pos, service, 'MICROSERVICE' AS entity_type, service AS entity, NULL AS http_method, NULL AS url, 'Microservice ''' || service || ''' (system=' || system || ') is defined in the IR at path src with ' || c || ' controller(s) exposing ' || e || ' HTTP endpoint(s).' AS content FROM s
    UNION ALL SELECT m.system, p, s_suppkey, pos, m.service, 'ENDPOINT', class || '.' || method, upper(http_method), 'api//' || m.service || '/' || s_suppkey || '/' || (pos + 1) || '/', upper(http_method) || ' api//' || m.service || '/' || s_suppkey || '/' || (pos + 1) || '/ is implemented by ' || class || '.' || method || ' in service ''' || m.service || ''' (p).'
      FROM m JOIN s ON s.service = m.service WHERE url IS NOT NULL)
  SELECT system, CAST(place AS INTEGER) AS place, '1.0.0' AS version, service, entity_type, entity, http_method, url, content FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY p, k, pos) - 1 AS place FROM rows) WHERE place < 400""")
def i1_evidence_rows(spark, sf):
    """Evidence of each system, its first 400 rows."""
    return IR.evidence_rows(_ir(spark, sf), "1.0.0")


@query(f"SELECT system, role, count(DISTINCT class) AS n FROM ({_METHODS}) GROUP BY system, role")
def i1_component_counts(spark, sf):
    return IR.component_counts(_ir(spark, sf))


@query("SELECT r_name AS system, n_name AS service, CAST(count(*) AS INTEGER) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 HAVING count(*) >= 4")
def i1_god_services(spark, sf):
    return IR.god_services(_ir(spark, sf))


@query(f"SELECT x.method_id AS caller, y.method_id AS callee FROM ({_METHODS}) x JOIN ({_METHODS}) y ON x.class = y.class AND x.service = y.service AND y.method = 'm1' WHERE x.role = 'Service'")
def i1_call_links(spark, sf):
    """Every method calls the first one of its own class; controllers' calls name no type, so they lead nowhere."""
    ir = graph.checkpointed(_ir(spark, sf))
    return IR.call_links(IR.methods(ir), IR.calls(ir))


# --- evidence: parts are methods, each calls the part of a tenth of its number; brands are services, types entities
_REACH = "RECURSIVE r AS (SELECT p_partkey AS endpoint, p_partkey AS method FROM part UNION SELECT endpoint, method // 10 FROM r WHERE method >= 10), reach AS (SELECT r.* FROM r JOIN part ON method = p_partkey)"


def _reach(spark, sf):
    p = _t(spark, sf, "part")
    edges = p.where("p_partkey >= 10").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 10").alias("dst")).join(p.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return symbolic.with_self(graph.reachable(edges), p.select(F.col("p_partkey").alias("endpoint")))


def _parts(spark, sf):
    names = F.array(*map(F.lit, ("PreAuthorize", "Secured", "Valid", "GetMapping")))
    protection = F.when(F.col("p_size") % 6 == 0, "PUBLIC").otherwise("PRIVATE")
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("endpoint"), F.col("p_partkey").alias("method"), F.col("p_brand").alias("service"), F.col("p_type").alias("entity"), F.get(names, F.col("p_size") % 9).alias("name"), protection.alias("protection"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("cc"))


@query(f"""WITH {_REACH}, a AS (SELECT endpoint, list(CASE p_size % 9 WHEN 0 THEN 'PreAuthorize' WHEN 1 THEN 'Secured' WHEN 2 THEN 'Valid' WHEN 3 THEN 'GetMapping' END) AS names FROM reach JOIN part ON method = p_partkey GROUP BY endpoint)
  SELECT endpoint, array_to_string(list_filter([CASE WHEN NOT list_has_any(names, ['PreAuthorize', 'Secured']) THEN 'LDA' END, CASE WHEN list_contains(names, 'PreAuthorize') THEN 'REQUIRES_ADMIN' END, CASE WHEN list_contains(names, 'Secured') THEN 'REQUIRES_AUTH' END,
    CASE WHEN list_contains(names, 'Valid') THEN 'INPUT_VALIDATION' END, CASE WHEN p_size % 6 = 0 THEN 'UNPROTECTED_ENDPOINT' END], lambda x: x IS NOT NULL), ',') AS findings FROM a JOIN part ON endpoint = p_partkey""")
def e1_auth_findings(spark, sf):
    p = _parts(spark, sf)
    return symbolic.auth_findings(p, _reach(spark, sf), p.where("name is not null").select("method", "name")).select("endpoint", F.array_join("findings", ",").alias("findings"))


@query("SELECT p_partkey AS endpoint FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)")
def e1_secret_flags(spark, sf):
    p = _t(spark, sf, "part")
    return symbolic.secret_flags(_parts(spark, sf), p.where("p_size = 50").select(F.col("p_brand").alias("service"), F.lit("HardcodedSecret").alias("kind")))


@query(f"WITH {_REACH} SELECT DISTINCT endpoint FROM reach JOIN part ON method = p_partkey WHERE p_size % 10 = 3")
def e1_sink_flags(spark, sf):
    """Methods are named findBySizeAnd.. where their size ends in 3."""
    named = _t(spark, sf, "part").select(F.col("p_partkey").alias("method"), F.when(F.col("p_size") % 10 == 3, "findBySizeAndBrand").otherwise("findById").alias("name"))
    return symbolic.sink_flags(_reach(spark, sf), named.where(X.injectable(F.col("name"))))


@query(f"WITH {_REACH} SELECT endpoint, CAST(sum(CASE WHEN p_size % 5 > 0 THEN p_size ELSE 1 END) AS BIGINT) AS complexity FROM reach JOIN part ON method = p_partkey GROUP BY endpoint")
def e1_complexity(spark, sf):
    return symbolic.complexity(_reach(spark, sf), _parts(spark, sf).select("method", "cc"))


@query(f"""WITH {_REACH}, o AS (SELECT DISTINCT p_type AS entity, p_brand AS service FROM part)
  SELECT e.p_partkey AS endpoint, count(DISTINCT m.p_type) FILTER (EXISTS (SELECT 1 FROM o WHERE o.entity = m.p_type AND o.service <> e.p_brand)) AS shared FROM part e JOIN reach ON endpoint = e.p_partkey JOIN part m ON method = m.p_partkey GROUP BY e.p_partkey""")
def e1_shared_entities(spark, sf):
    p = _parts(spark, sf)
    return symbolic.shared_entities(p.select("endpoint", "service"), _reach(spark, sf), p.select("method", "entity"), p.select("method", "service"))


@query(f"WITH {_REACH} SELECT endpoint, count(l_partkey) AS n FROM reach LEFT JOIN lineitem ON l_partkey = method AND l_returnflag = 'R' GROUP BY endpoint")
def e1_access_counts(spark, sf):
    """Returned lineitems of a part are its accesses."""
    returned = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("method"))
    return symbolic.access_counts(_parts(spark, sf).select("endpoint"), _reach(spark, sf), returned)


# --- names and URLs
_PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"
_SCEN = f"SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN {_PAGE} WHEN 1 THEN '/x' || {_PAGE} ELSE '/none' || page_id END AS uri, CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method FROM pages"
_ENDS = f"SELECT page_id AS pos, {_PAGE} AS uri, CASE page_id % 4 WHEN 1 THEN 'POST' WHEN 3 THEN 'POST' ELSE 'GET' END AS method, page_id AS endpoint FROM pages"


def _scenarios(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "[?#].*$", "")
    k = F.col("page_id")
    uri = F.when(k % 3 == 0, path).when(k % 3 == 1, F.concat(F.lit("/x"), path)).otherwise(F.concat(F.lit("/none"), k))
    return _t(spark, sf, "pages").select(k.alias("id"), uri.alias("uri"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"))


@query(f"""WITH s AS ({_SCEN}), e AS ({_ENDS}), m AS (SELECT s.id, e.endpoint, CASE WHEN s.uri = e.uri THEN 0 ELSE 1 END AS rank, pos FROM s JOIN e ON s.method = e.method AND s.uri <> '' AND e.uri <> '' AND (suffix(s.uri, e.uri) OR suffix(e.uri, s.uri)))
  SELECT s.id, arg_min(endpoint, rank * 1000000 + pos) AS endpoint, coalesce(CASE min(rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' END, 'none') AS how FROM s LEFT JOIN m ON m.id = s.id GROUP BY s.id""")
def n1_enriched(spark, sf):
    s = _scenarios(spark, sf)
    return enrich.enriched(s.select("id", "uri", "method"), s.select(F.col("id").alias("pos"), F.col("path").alias("uri"), "method", F.col("id").alias("endpoint")))


@query(f"""WITH u AS (SELECT page_id AS id, 'GET' AS method, {_PAGE} AS url, string_split({_PAGE}, '/') AS p FROM pages), t AS (SELECT unnest([0, 1, 2]) AS pos, unnest(['/en/{{id}}', '/de/page', '/fr/page']) AS template),
  m AS (SELECT id, pos, template, CAST(100 * len(list_filter(range(1, len(p) + 1), lambda i: p[i] <> '' AND lower(p[i]) = lower(string_split(template, '/')[i]))) // 2 AS INTEGER) AS score FROM u, t WHERE len(p) = 3 AND template NOT LIKE '%{{%' AND len(list_filter(p, lambda x: x = '')) = 1)
  SELECT id, arg_max(pos, score * 10 - pos) AS pos, arg_max(template, score * 10 - pos) AS template, max(score) AS score FROM m WHERE score >= 50 GROUP BY id""")
def n1_fuzzy_templates(spark, sf):
    """URLs of two segments against templates; half of the fixed segments are enough here."""
    u = _scenarios(spark, sf).select("id", F.lit("s").alias("service"), F.lit("GET").alias("method"), F.col("path").alias("url")).where("path != '/' and path not like '%/' and path not like '%//%'")
    t = spark.createDataFrame([(0, "s", "GET", "/en/{id}"), (1, "s", "GET", "/de/page"), (2, "s", "GET", "/fr/page")], "pos int, service string, method string, template string")
    return enrich.fuzzy(u, t, least=50)


_RULES = "SELECT 's' || (p_partkey % 5) AS service, '/' || p_brand AS pattern, CASE WHEN p_partkey % 3 > 0 THEN 'GET' END AS http_method, CASE WHEN p_size % 4 = 0 THEN 'yaml' ELSE 'java' END AS source, p_partkey AS priority FROM part"


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY service, pattern, http_method ORDER BY source = 'yaml' DESC, CASE WHEN source <> 'yaml' THEN -priority END, priority) AS n FROM ({_RULES}))
  SELECT service, pattern, http_method, source, priority, CAST(row_number() OVER (PARTITION BY service ORDER BY priority DESC) AS INTEGER) AS place FROM b WHERE n = 1""")
def n1_merged_rules(spark, sf):
    k = F.col("p_partkey")
    rules = _t(spark, sf, "part").select(F.concat(F.lit("s"), k % 5).alias("service"), F.concat(F.lit("/"), "p_brand").alias("pattern"), F.when(k % 3 > 0, "GET").alias("http_method"), F.when(F.col("p_size") % 4 == 0, "yaml").otherwise("java").alias("source"), k.alias("priority"), k.alias("pos"))
    return enrich.merged_rules(rules).drop("pos")


@query(f"WITH s AS ({_SCEN}) SELECT count(*) AS total, count_if(e IN (SELECT method || ' ' || uri FROM s)) AS matched, round(count_if(e IN (SELECT method || ' ' || uri FROM s)) / count(*), 4) AS rate FROM (SELECT 'GET ' || {_PAGE} AS e FROM pages)")
def n1_coverage(spark, sf):
    s = _scenarios(spark, sf)
    return enrich.coverage(s.select("method", "uri"), s.select(F.concat(F.lit("GET "), "path").alias("endpoint")))


@query("""WITH f AS (SELECT p_partkey AS field, p_partkey % 30 AS type, CASE WHEN p_size % 3 > 0 THEN p_size % 9 END AS q FROM part), n AS (SELECT s_nationkey AS type, count(*) AS n, arg_min(s_name, s_suppkey) AS one, arg_min(s_name, s_suppkey) FILTER (s_suppkey % 11 = 0) AS prim FROM supplier GROUP BY 1),
  m AS (SELECT s_nationkey AS type, s_suppkey % 7 AS q, arg_min(s_name, s_suppkey) AS named FROM supplier GROUP BY 1, 2)
  SELECT field, CASE WHEN f.q IS NOT NULL AND named IS NOT NULL THEN 'QUALIFIER' WHEN f.q IS NOT NULL OR n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'EXACT' WHEN prim IS NOT NULL THEN 'PRIMARY' ELSE 'AMBIGUOUS' END AS how, CASE WHEN f.q IS NOT NULL THEN named WHEN n = 1 THEN one ELSE prim END AS bean
  FROM f LEFT JOIN n USING (type) LEFT JOIN m ON m.type = f.type AND m.q = f.q""")
def n1_injected(spark, sf):
    """Parts are fields whose type is a nation; its suppliers are the beans."""
    f = _t(spark, sf, "part").select(F.col("p_partkey").alias("field"), (F.col("p_partkey") % 30).alias("type"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 9).alias("qualifier"))
    beans = _t(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("type"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("bean"), (F.col("s_suppkey") % 11 == 0).alias("primary"), (F.col("s_suppkey") % 7).alias("name"))
    return enrich.injected(f, beans)


_ANTI = """'{"a": [{"antiPattern": "' || p_brand || '"}, {"x": {"antiPatterns": ["Cycle", "' || p_brand || '", {"k": 1}]}}, [["antiPattern"]]], "antiPattern": ' || CASE p_size % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"Cycle"' ELSE '{"antiPattern": "Deep"}' END || '}'"""


@query("""SELECT id, name, count(*) AS n FROM (SELECT p_partkey AS id, unnest([p_brand, p_brand, 'Cycle', '{"k":1}', CASE p_size % 3 WHEN 1 THEN 'Cycle' WHEN 2 THEN 'Deep' END]) AS name FROM part) WHERE name IS NOT NULL GROUP BY id, name""")
def n2_anti_patterns(spark, sf):
    """Parts are documents that name anti-patterns in nested objects and lists."""
    return census.anti_patterns(_t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_ANTI).alias("data")))


_REPO = "SELECT o_custkey AS endpoint, CASE o_orderstatus WHEN 'F' THEN 'POST' ELSE 'GET' END AS http_method, l_partkey AS repo, CASE l_returnflag WHEN 'A' THEN 'saveAll' WHEN 'N' THEN 'findById' ELSE 'deleteOld' END AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"SELECT endpoint, repo, CAST(bit_or(CASE name WHEN 'saveAll' THEN CASE http_method WHEN 'POST' THEN 8 ELSE 2 END WHEN 'findById' THEN 4 ELSE 1 END) AS INTEGER) AS ops FROM ({_REPO}) GROUP BY endpoint, repo")
def p2_operation_masks(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_returnflag") == "A", "saveAll").when(F.col("l_returnflag") == "N", "findById").otherwise("deleteOld")
    return enrich.operation_masks(o.select(F.col("o_custkey").alias("endpoint"), F.when(F.col("o_orderstatus") == "F", "POST").otherwise("GET").alias("http_method"), F.col("l_partkey").alias("repo"), name.alias("name")))


# --- scenarios
@query(f"""WITH m AS ({_MATRIX}), r AS (SELECT root, role, role_idx, min(v) = 1 AS t, bool_or(position = 0 AND v = 1) AS e FROM m WHERE position <= 2 GROUP BY ALL),
  b AS (SELECT root, list(role ORDER BY role_idx) AS roles, coalesce(list(role ORDER BY role_idx) FILTER (t), []) AS chain, coalesce(list(role ORDER BY role_idx) FILTER (e), []) AS entry FROM r GROUP BY root),
  a AS (SELECT root, roles, CASE WHEN len(required) > 0 THEN required WHEN len(chain) > 0 THEN chain ELSE entry END AS allowed, n_name FROM b JOIN ({_CHAIN}) c USING (root) JOIN nation ON n_nationkey = root WHERE c.position = 0)
  SELECT root, 'scn_' || root AS scenario, CASE WHEN root % 3 > 0 THEN 'DownstreamPolicyConsistency' ELSE 'EntryPointAuthorization' END AS type, array_to_string(allowed, ',') AS allowed, array_to_string(list_filter(roles, lambda x: NOT list_contains(allowed, x)), ',') AS denied,
    array_to_string(list_transform(roles, lambda x: x || CASE WHEN list_contains(allowed, x) THEN '=2xx' ELSE '=403' END), ',') AS status, CASE WHEN root % 3 > 0 THEN 'HIGH' ELSE 'LOW' END AS awareness,
    CASE WHEN root % 3 = 0 THEN 'entrypoint_status_matrix' WHEN root % 2 = 0 THEN 'downstream_consistent_path' ELSE 'downstream_inconsistency_cot' END AS template FROM a""")
def p1_scenarios(spark, sf):
    """Scenarios of nations, over the first three endpoints of their chains."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("root"), F.col("n_name").alias("uri"), (F.col("n_nationkey") % 3).alias("max_depth"), (F.col("n_nationkey") % 4 == 0).alias("is_public"))
    entry = _chain(spark, sf).where("position = 0").select("root", "required")
    s = scenario.inferred(scenario.assembled(p1_permission_matrix(spark, sf).where("position <= 2"), n.join(entry, "root")))
    label = F.when(F.col("root") % 2 == 0, "DOWNSTREAM_CONSISTENT_PUBLIC_PUBLIC").otherwise("DOWNSTREAM_OVER_PERMISSIVE_PUBLIC_PUBLIC")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return s.select("root", "scenario", "type", joined("allowed"), joined("denied"), joined("status"), "awareness", scenario.template(F.col("type"), label, F.col("awareness")).alias("template"))


# --- censuses
@query("""SELECT p_brand AS service, p_type AS method, count(*) AS n, count(DISTINCT p_size) AS controllers, CAST(count_if(p_size % 2 = 0) AS BIGINT) AS public, grouping(p_brand) AS all_services, grouping(p_type) AS all_methods FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())""")
def n2_endpoint_statistics(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("service"), F.col("p_type").alias("method"), F.col("p_size").alias("controller"), (F.col("p_size") % 2 == 0).alias("is_public"))
    return census.endpoint_statistics(p)


def _issues(spark, sf):
    names = F.array(*map(F.lit, ("CRITICAL", "MAJOR", "MINOR")))
    k = F.col("l_orderkey")
    return _t(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("pos"), F.get(names, (k % 3).cast("int")).alias("severity"), F.col("l_linenumber").alias("minutes"), F.concat(F.lit("r"), F.col("l_suppkey") % 20).alias("rule"), F.col("l_returnflag").alias("message"), F.concat(F.lit("a:src/F"), F.col("l_partkey") % 30).alias("file"))


_ISSUES = "SELECT l_orderkey * 10 + l_linenumber AS pos, ['CRITICAL', 'MAJOR', 'MINOR'][l_orderkey % 3 + 1] AS severity, l_linenumber AS minutes, 'r' || (l_suppkey % 20) AS rule, l_returnflag AS message, 'F' || (l_partkey % 30) AS file FROM lineitem"


@query(f"SELECT severity, count(pos) AS n, round(coalesce(sum(minutes), 0) / 60, 1) AS hours FROM (SELECT unnest(['BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO']) AS severity) LEFT JOIN ({_ISSUES}) USING (severity) GROUP BY severity")
def n2_issue_severities(spark, sf):
    return census.issue_severities(_issues(spark, sf))


@query(f"SELECT rule, count(*) AS n, arg_min(severity, pos) AS severity, arg_min(message, pos) AS message FROM ({_ISSUES}) GROUP BY rule")
def n2_issue_rules(spark, sf):
    return census.issue_rules(_issues(spark, sf))


@query(f"SELECT file, count(*) AS n FROM ({_ISSUES}) GROUP BY file ORDER BY n DESC, min(pos) LIMIT 10")
def n2_issue_files(spark, sf):
    """The ten files of most issues."""
    return census.issue_files(_issues(spark, sf))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1)
  SELECT strftime(day, '%Y-%m') AS month, round(sum(cost), 2) AS cost, count(*) AS days, strftime(arg_max(day, cost), '%Y%m%d') AS top_day, max(cost) AS top_cost FROM d GROUP BY 1""")
def s3_spending(spark, sf):
    return census.spending(_t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("cost")))


@query("SELECT s_nationkey AS key, max(5) - sum(s_suppkey % 3) + sum(s_suppkey % 7) AS wanted, n_nationkey % 13 AS \"limit\" FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey, n_nationkey HAVING 5 - sum(s_suppkey % 3) + sum(s_suppkey % 7) > n_nationkey % 13")
def s3_over_quota(spark, sf):
    d = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.lit(5).alias("used"), (F.col("s_suppkey") % 3).alias("managed"), (F.col("s_suppkey") % 7).alias("target"))
    return census.over_quota(d, _t(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") % 13).alias("limit")))


# --- answers and the store
@query("""SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 5 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN turn % 3 = 0 THEN 'LOW' WHEN conv_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  concat_ws(',', CASE WHEN conv_id % 2 = 0 THEN 'exact_match' END, CASE WHEN turn % 5 <> 0 THEN 'has_ir_evidence' END, CASE WHEN turn % 5 <> 0 THEN 'has_graph_evidence' END, CASE WHEN turn % 3 = 0 THEN 'truncated_context' END) AS reasons FROM conversations""")
def c1_confidence(spark, sf):
    turn, conv = F.col("turn"), F.col("conv_id")
    arr = lambda c, *x: F.when(c, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>"))
    c = _t(spark, sf, "conversations").select((conv * 100 + turn).alias("id"), arr(conv % 2 == 0, "Order").alias("matched"), arr(turn % 5 != 0, "IR", "GRAPH").alias("kinds"), arr(F.lit(True), " order ").alias("names"), F.lit(1).alias("n_citations"), arr(turn % 3 == 0, "TRUNCATED_CONTEXT").alias("flags"), arr(F.lit(False)).alias("missing"))
    return answers.confidence(c).select("id", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT p_partkey AS id, p_name AS name, p_size || '.' || (p_partkey % 7) || '.0' AS version FROM part WHERE p_size % 3 > 0 AND regexp_matches(lower(p_name), 'a[-_\\s]*b|r[-_\\s]*e')")
def s1_by_name(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, F.concat_ws(".", "p_size", F.col("p_partkey") % 7, F.lit("0"))).alias("version"))
    return store.by_name(p, "a-b").union(store.by_name(p, "R e")).distinct()


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS updated, (SELECT count(*) FROM orders) AS total, CAST(ceil((SELECT count(*) FROM orders) / 25) AS BIGINT) AS pages FROM orders ORDER BY o_orderkey DESC LIMIT 25 OFFSET 50")
def s1_listing(spark, sf):
    """The third page of 25 orders."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.lit(None).cast("string").alias("updated"), F.col("o_orderpriority").alias("payload"))
    return store.listing(o, [F.desc("o_orderkey")], 2, 25, ["payload", "created"])
