"""Resolution of remote calls bound to the tables of a folder: parts are endpoints, customers call them."""

from __future__ import annotations

from pyspark.sql import functions as F

from archspark.operators import containment, graph, policy, routes
from archspark.plans.bindings import _t, query
from archspark.sources import graphs
from archspark.sources.ir import decoded

# Twenty services named by letter; an endpoint's URL begins with its service's path, a variable, or a version.
_TEMPLATES = """SELECT p_partkey AS pos, 'ts-' || chr(CAST(97 + p_partkey % 20 AS INTEGER)) || 'x-service' AS service, CASE WHEN p_partkey % 3 = 0 THEN 'post' ELSE 'GET' END AS method, 'e' || p_partkey AS endpoint,
  CASE p_partkey % 4 WHEN 0 THEN '/api/v1/' || chr(CAST(97 + p_partkey % 20 AS INTEGER)) || 'xservice/item/' || p_partkey % 97 || '/{id}' WHEN 1 THEN '/{tenant}/k' || p_partkey % 211 || '/' WHEN 2 THEN 'api/v1/' || chr(CAST(97 + p_partkey % 20 AS INTEGER)) || 'xservice/{name}/n' || p_partkey % 53
    ELSE '/a/b/c/d/e/f/g/h/i/j' || p_partkey % 31 END AS template FROM part"""
_CALLS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TS_' || chr(CAST(97 + c_custkey % 20 AS INTEGER)) || 'x_service' WHEN 2 THEN NULL WHEN 3 THEN 'ts-nowhere' ELSE 'ts-' || chr(CAST(97 + c_custkey * 7 % 20 AS INTEGER)) || 'x-service' END AS service,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'POST' ELSE 'get' END AS method,
  CASE c_custkey % 6 WHEN 0 THEN 'http://host:80/api/v1/' || chr(CAST(97 + c_custkey % 20 AS INTEGER)) || 'xservice/item/' || c_custkey % 97 || '/9?q=1' WHEN 1 THEN '/t.1/K' || c_custkey % 300 WHEN 2 THEN '/api/v1/' || chr(CAST(97 + c_custkey % 20 AS INTEGER)) || 'xservice/me/n' || c_custkey % 53 || '/'
    WHEN 3 THEN '/a/b/c/d/e/f/g/h/i/j' || c_custkey % 40 WHEN 4 THEN '/{x}/k' || c_custkey % 211 ELSE '/bad segment/k1' END AS url FROM customer"""

_SEGMENTS = "list_transform(CASE WHEN {p} = '' THEN [] ELSE string_split({p}, '/') END, lambda s: CASE WHEN regexp_full_match(s, '\\{{.*\\}}') THEN '{{}}' ELSE lower(s) END)"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace({u}, '^https?://[^/]+', ''), '\\?.*$', ''), '^/+|/+$', '', 'g')"
_NAME = "regexp_replace(regexp_replace(lower({s}), '[-_]', '', 'g'), '^(ts|ms|svc)', '')"
_PATH_NAME = """CASE WHEN regexp_extract(url, '/api/v[0-9]+/([a-zA-Z]+[Ss]ervice)/', 1) <> '' THEN 'ts-' || regexp_replace(lower(regexp_extract(url, '/api/v[0-9]+/([a-zA-Z]+[Ss]ervice)/', 1)), 'service$', '') || '-service' END"""
_FITS = "len(u.s) = len(t.s) AND len(list_filter(list_zip(u.s, t.s, u.raw), lambda z: NOT CASE WHEN z[2] = '{}' THEN regexp_full_match(z[3], '[A-Za-z0-9._-]{1,200}') ELSE z[1] = z[2] END)) = 0"
_AGREES = "len(u.s) = len(t.s) AND len(list_filter(list_zip(u.s, t.s), lambda z: (z[1] = '{}') <> (z[2] = '{}'))) = 0"
_SCORE = "CASE WHEN len(list_filter(t.s, lambda x: x <> '{}')) = 0 THEN 100 ELSE 100 * len(list_filter(list_zip(u.s, t.s), lambda z: z[1] = z[2] AND z[1] <> '{}')) // len(list_filter(t.s, lambda x: x <> '{}')) END"
RESOLUTION = f"""WITH t AS (SELECT pos, service, {_NAME.format(s='service')} AS name, upper(method) AS method, endpoint, template, {_SEGMENTS.format(p=_NORMAL.format(u='template'))} AS s FROM ({_TEMPLATES})),
  c AS (SELECT id, coalesce(service, {_PATH_NAME}) AS service, service IS NOT NULL AS own, upper(method) AS method, url, {_NORMAL.format(u='url')} AS p FROM ({_CALLS})),
  u AS (SELECT *, {_NAME.format(s='service')} AS name, {_SEGMENTS.format(p='p')} AS s, CASE WHEN p = '' THEN [] ELSE string_split(p, '/') END AS raw FROM c),
  hit AS (SELECT u.id, u.name, t.name AS t_name, t.pos, t.service AS t_service, {_FITS} AS fits, CASE WHEN {_AGREES} THEN {_SCORE} ELSE 0 END AS score, len(list_filter(t.s, lambda x: x <> '{{}}')) AS fixed FROM u JOIN t ON u.method = t.method AND len(u.s) = len(t.s)),
  best AS (SELECT id, t_name, coalesce(min_by(pos, pos - 1000000 * fixed) FILTER (fits), min_by(pos, pos - 10000000 * score) FILTER (score >= 90)) AS pos FROM hit GROUP BY id, t_name),
  found AS (SELECT id, coalesce(arg_min(t_service, pos) FILTER (fits), arg_min(t_service, pos - 10000000 * score) FILTER (score >= 80)) AS found FROM hit GROUP BY id),
  r AS (SELECT u.id, u.service, own, a.pos, found, b.pos AS again FROM u LEFT JOIN best a ON a.id = u.id AND a.t_name = u.name LEFT JOIN found f ON f.id = u.id LEFT JOIN best b ON b.id = u.id AND b.t_name = {_NAME.format(s='found')})
  SELECT r.id, CASE WHEN r.pos IS NULL AND (again IS NOT NULL OR r.service IS NULL) THEN found ELSE r.service END AS service, t.endpoint, t.template,
    CASE WHEN r.pos IS NOT NULL AND own THEN 'own' WHEN r.pos IS NOT NULL THEN 'path' WHEN again IS NOT NULL AND r.service IS NULL THEN 'index' WHEN again IS NOT NULL THEN 'retry' END AS how
  FROM r LEFT JOIN t ON t.pos = coalesce(r.pos, again)"""


def _letter(key, by: int = 1):
    return F.chr((97 + key * by % 20).cast("long"))


def _templates(spark, sf):
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    urls = F.when(k % 4 == 0, text("/api/v1/", _letter(k), "xservice/item/", k % 97, "/{id}")).when(k % 4 == 1, text("/{tenant}/k", k % 211, "/")).when(k % 4 == 2, text("api/v1/", _letter(k), "xservice/{name}/n", k % 53)).otherwise(text("/a/b/c/d/e/f/g/h/i/j", k % 31))
    return _t(spark, sf, "part").select(k.alias("pos"), text("ts-", _letter(k), "x-service").alias("service"), F.when(k % 3 == 0, "post").otherwise("GET").alias("method"), text("e", k).alias("endpoint"), urls.alias("template"))


def _url_calls(spark, sf):
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    service = F.when(k % 5 == 1, text("TS_", _letter(k), "x_service")).when(k % 5 == 3, "ts-nowhere").when(k % 5 == 4, text("ts-", _letter(k, 7), "x-service"))
    url = F.when(k % 6 == 0, text("http://host:80/api/v1/", _letter(k), "xservice/item/", k % 97, "/9?q=1")).when(k % 6 == 1, text("/t.1/K", k % 300)).when(k % 6 == 2, text("/api/v1/", _letter(k), "xservice/me/n", k % 53, "/"))
    url = url.when(k % 6 == 3, text("/a/b/c/d/e/f/g/h/i/j", k % 40)).when(k % 6 == 4, text("/{x}/k", k % 211)).otherwise("/bad segment/k1")
    return _t(spark, sf, "customer").select(k.alias("id"), service.alias("service"), F.when(k % 11 == 0, None).when(k % 3 == 0, "POST").otherwise("get").alias("method"), url.alias("url"))


@query(RESOLUTION)
def n3_resolved_calls(spark, sf):
    """Customers' calls and the parts that they mean."""
    return routes.resolved_calls(_url_calls(spark, sf), _templates(spark, sf))


@query("""WITH s AS (SELECT DISTINCT 'r' || p_partkey % 300 AS service FROM part), c AS (SELECT c_custkey AS pos, 'i' || c_custkey AS id, 'Sr' || c_custkey || 'x' AS name, c_mktsegment || '-r' || c_custkey % 7 AS microservice FROM customer),
  m AS (SELECT service, min(pos) AS pos FROM s JOIN c ON contains(name, service) OR contains(id, service) OR contains(microservice, service) GROUP BY service)
  SELECT s.service, m.pos, 'i' || m.pos AS id FROM s LEFT JOIN m USING (service)""")
def n3_component_of_service(spark, sf):
    """Customers are components, remainders of part numbers services."""
    services = _t(spark, sf, "part").select(F.concat(F.lit("r"), F.col("p_partkey") % 300).alias("service"))
    k = F.col("c_custkey")
    components = _t(spark, sf, "customer").select(k.alias("pos"), F.concat(F.lit("i"), k).alias("id"), F.concat(F.lit("Sr"), k, F.lit("x")).alias("name"), F.concat("c_mktsegment", F.lit("-r"), k % 7).alias("microservice"))
    return containment.component_of(services, components)


@query("""WITH n AS (SELECT s_nationkey AS snapshot, s_name AS name FROM supplier), c AS (SELECT c_nationkey AS snapshot, 'Supplier#' || lpad(CAST(c_custkey % 200 + 1 AS VARCHAR), 9, '0') AS src, 'get x.Supplier#' || lpad(CAST(c_custkey * 7 % 300 + 1 AS VARCHAR), 9, '0') || '(' || c_mktsegment || ')' AS signature FROM customer)
  SELECT DISTINCT c.snapshot, src, name AS dst FROM c JOIN n ON n.snapshot = c.snapshot AND contains(signature, name) WHERE src <> name""")
def g1_inferred_edges(spark, sf):
    """Nations are snapshots, their suppliers nodes; customers are calls whose signatures name suppliers."""
    k, numbered = F.col("c_custkey"), lambda x: F.concat(F.lit("Supplier#"), F.lpad(x.cast("string"), 9, "0"))
    calls = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("snapshot"), numbered(k % 200 + 1).alias("src"), F.concat(F.lit("get x."), numbered(k * 7 % 300 + 1), F.lit("("), "c_mktsegment", F.lit(")")).alias("signature"))
    return containment.inferred_edges(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("snapshot"), F.col("s_name").alias("name")), calls)


_MASKS = """WITH e AS (SELECT c_nationkey AS service, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /n' || c_custkey % 97 || '/' || CASE WHEN c_custkey % 3 = 0 THEN '{?}' ELSE 'v' || c_custkey % 11 END AS name FROM customer),
  r AS (SELECT p_partkey % 24 AS service, p_partkey % 24 AS file, p_partkey AS rule, CASE p_size % 3 WHEN 0 THEN 'hasRole' WHEN 1 THEN 'hasAnyRole' ELSE 'permitAll' END AS kind, CASE p_size % 3 WHEN 0 THEN ['r' || p_size % 7] WHEN 1 THEN ['r' || p_size % 7, 'q' || p_size % 5] ELSE [] END AS roles,
    CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 'all' ELSE 'own' END WHEN 1 THEN 'first' ELSE 'own' END AS how, CASE p_partkey % 4 WHEN 0 THEN 'GET /n' || p_partkey % 97 WHEN 1 THEN 'POST /n' || p_partkey % 97 || '/{?}' WHEN 2 THEN '/n' || p_partkey % 9 ELSE '/n' || p_partkey % 97 || '/v' || p_partkey % 13 END AS needle FROM part),
  f AS (SELECT DISTINCT p_partkey % 24 AS file, p_partkey % 24 % 2 = 0 AS authenticated FROM part), one AS (SELECT name, min(pos) AS pos FROM e GROUP BY name),
  hit AS (SELECT e.pos, file, rule, kind, roles FROM e JOIN r ON (how = 'own' AND e.service = r.service AND contains(name, needle)) OR (how = 'all' AND contains(name, needle)) UNION ALL SELECT one.pos, file, rule, kind, roles FROM one JOIN r ON how = 'first' AND name = needle
    UNION ALL SELECT e.pos, file, 2147483647, CASE WHEN authenticated THEN 'authenticated' ELSE 'end' END, NULL FROM e JOIN f ON e.service = file),
  x AS (SELECT pos, file, rule, kind, roles FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY file, rule) AS n FROM hit) WHERE n = 1),
  named AS (SELECT file, rule, unnest(roles) AS role, unnest(range(len(roles))) AS nth FROM (SELECT file, rule, roles FROM r WHERE kind = 'hasRole' UNION SELECT file, rule, roles FROM x WHERE kind = 'hasAnyRole')),
  seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY file, rule, nth) AS n FROM named) WHERE n = 1),
  known AS (SELECT role, file, rule, CAST(8 << (row_number() OVER (ORDER BY file, rule, nth) - 1) AS BIGINT) AS bit FROM seen UNION ALL SELECT unnest(['UnauthenticatedRole', 'user', 'admin']), -1, -1, unnest([1, 2, 4]))
  SELECT service, e.pos, CAST(coalesce((SELECT sum(bit) FROM known k WHERE CASE WHEN x.pos IS NULL THEN false WHEN x.kind IN ('hasRole', 'hasAnyRole') THEN list_contains(x.roles, k.role) ELSE (k.file, k.rule) < (x.file, x.rule) AND NOT (x.kind = 'authenticated' AND k.role = 'UnauthenticatedRole') END), 0) AS BIGINT) AS mask
  FROM e LEFT JOIN x ON x.pos = e.pos"""


@query(_MASKS)
def p3_role_masks(spark, sf):
    """Nations are services with a security file each (but one), customers endpoints, parts rules."""
    k, c, size = F.col("p_partkey"), F.col("c_custkey"), F.col("p_size")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    endpoints = _t(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("service"), c.alias("pos"), F.when(c % 2 == 0, "GET").otherwise("POST").alias("method"), text("/n", c % 97, "/", F.when(c % 3 == 0, "{?}").otherwise(text("v", c % 11))).alias("url"))
    pattern = F.when(k % 4 == 0, text("/n", k % 97, "/**")).when(k % 4 == 1, text("/n", k % 97, "/*")).when(k % 4 == 2, text("/n", k % 9, "/**")).otherwise(text("/n", k % 97, "/v", k % 13))
    roles = F.when(size % 3 == 0, F.array(text("r", size % 7))).when(size % 3 == 1, F.array(text("r", size % 7), text("q", size % 5))).otherwise(F.array().cast("array<string>"))
    kind = F.when(size % 3 == 0, "hasRole").when(size % 3 == 1, "hasAnyRole").otherwise("permitAll")
    rules = _t(spark, sf, "part").select((k % 24).alias("service"), (k % 24).alias("file"), k.alias("pos"), kind.alias("kind"), F.when(k % 4 == 0, "GET").when(k % 4 == 1, "POST").alias("method"), F.array(pattern).alias("patterns"), roles.alias("roles"))
    files = rules.select("service", "file", (F.col("file") % 2 == 0).alias("authenticated")).distinct()
    return containment.role_masks(endpoints, rules, files, {1: containment.UNAUTHENTICATED, 2: "user", 4: "admin"})


# Parts call the part of a third of their number, and the next of their block of four, the last of which calls the first.
_RING = "SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey >= 12 UNION SELECT p_partkey, p_partkey // 4 * 4 + (p_partkey + 1) % 4 FROM part WHERE p_partkey % 12 < 8 AND p_partkey // 4 * 4 + (p_partkey + 1) % 4 IN (SELECT p_partkey FROM part)"
_BLOCKS = f"WITH RECURSIVE e AS ({_RING}), r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM r JOIN e ON node = src)"


def _ring(spark, sf):
    p, k = _t(spark, sf, "part").select("p_partkey"), F.col("p_partkey")
    following = F.expr("p_partkey div 4 * 4 + (p_partkey + 1) % 4")
    ring = p.where(k % 12 < 8).select(k.alias("src"), following.alias("dst")).join(p.select(k.alias("dst")), "dst", "left_semi").select("src", "dst")
    return p.where(k >= 12).select(k.alias("src"), F.expr("p_partkey div 3").alias("dst")).union(ring).distinct()


@query(f"""{_BLOCKS}, m AS (SELECT a.root AS id, min(a.node) AS scc FROM r a JOIN r b ON a.root = b.node AND a.node = b.root GROUP BY a.root)
  SELECT DISTINCT a.scc AS src, b.scc AS dst FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.scc <> b.scc""")
def g5_condensation(spark, sf):
    """Links between the strong components of calling parts."""
    edges = graph.checkpointed(_ring(spark, sf))
    return graph.condensation(graph.components(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), edges), edges)


@query(f"""{_BLOCKS} SELECT root AS id, CAST(bit_or(CAST(1 AS BIGINT) << (p_size % 41)) AS BIGINT) AS bits FROM r JOIN part ON p_partkey = node GROUP BY root""")
def g5_accumulated_flags(spark, sf):
    """Each part's flag, by its size, and those of all parts that it reaches."""
    nodes = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("shiftleft(1L, p_size % 41)").alias("bits"))
    return graph.accumulated(nodes, _ring(spark, sf))


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part")
def s1_gzip_payloads(spark, sf):
    """Parts written as gzip payloads and read again."""
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), graphs.gzip_payload(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("payload"))
    return decoded(rows, "payload", "name string, size int, price double")


@query("""SELECT role, row_number() OVER (ORDER BY CASE WHEN r % 3 = 0 THEN r ELSE 999 END, role) - 1 AS idx FROM (SELECT DISTINCT 'R' || p_partkey % 200 AS role, p_partkey % 200 AS r FROM part)""")
def p3_role_order(spark, sf):
    """Remainders of part numbers are roles, a third of them with a priority."""
    r = F.col("p_partkey") % 200
    parts = _t(spark, sf, "part").select(F.concat(F.lit("R"), r).alias("role"), r.alias("priority"))
    return policy.role_order(parts.select(F.array("role").alias("required")), parts.where("priority % 3 = 0"))


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS service FROM supplier WHERE s_nationkey % 5 < 3), f AS (SELECT DISTINCT s_nationkey AS service FROM supplier WHERE s_suppkey % 6 < 2)
  SELECT c_custkey AS id, (c_custkey % 2 = 0 OR c_custkey % 7 = 0) AND c_nationkey IN (SELECT service FROM m) AND c_nationkey IN (SELECT service FROM f) AS optional FROM customer""")
def p3_optional_authentication(spark, sf):
    """Customers are endpoints of nations, whose suppliers name mechanisms and filters."""
    c, s, n = F.col("c_custkey"), F.col("s_suppkey"), F.col("s_nationkey")
    endpoints = _t(spark, sf, "customer").select(c.alias("id"), F.col("c_nationkey").alias("service"), (c % 2 == 1).alias("required"), (c % 7 == 0).alias("permit_all"))
    kinds = F.when(n % 5 == 0, "JWT").when(n % 5 == 1, "OAUTH2").when(n % 5 == 2, "API_KEY").when(n % 5 == 3, "SESSION")
    names = F.when(s % 6 == 0, "JWTFilter").when(s % 6 == 1, "MyTokenCheck").otherwise("Cors")
    supplier = _t(spark, sf, "supplier")
    return policy.optional_authentication(endpoints, supplier.select(n.alias("service"), kinds.alias("type")), supplier.select(n.alias("service"), names.alias("name"))).select("id", "optional")


_SITES = """WITH p AS (SELECT p_brand AS class, 'm' || p_size AS method, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'x.Y#m' || p_size WHEN 1 THEN 'm' || p_size WHEN 2 THEN 'zm' || p_size WHEN 3 THEN 'a&b.m' || p_size END AS called_from FROM part),
  own AS (SELECT * FROM p WHERE pos % 3 = 0 AND (called_from = method OR suffix(called_from, '&' || method) OR suffix(called_from, '#' || method) OR suffix(called_from, '.' || method))),
  rest AS (SELECT DISTINCT class, method FROM p WHERE (class, method) NOT IN (SELECT (class, method) FROM own))
  SELECT class, method, 'method' AS level, pos FROM own UNION ALL SELECT rest.class, rest.method, 'class', p.pos FROM rest JOIN p ON p.class = rest.class AND p.pos % 3 > 0 AND (called_from = rest.method OR suffix(called_from, '&' || rest.method) OR suffix(called_from, '#' || rest.method) OR suffix(called_from, '.' || rest.method))"""


@query(_SITES)
def n3_call_sites(spark, sf):
    """Brands are classes, their sizes methods; parts are calls, a third of them listed with a method."""
    k, size = F.col("p_partkey"), F.concat(F.lit("m"), "p_size")
    named = F.when(k % 5 == 0, F.concat(F.lit("x.Y#"), size)).when(k % 5 == 1, size).when(k % 5 == 2, F.concat(F.lit("z"), size)).when(k % 5 == 3, F.concat(F.lit("a&b."), size))
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("class"), size.alias("method"), k.alias("pos"), named.alias("called_from"), F.lit("Endpoint").alias("type"))
    return policy.call_sites(p, p.where("pos % 3 = 0"), p.where("pos % 3 > 0").drop("method"), endpoints_only=True)
