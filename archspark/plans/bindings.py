"""The operators bound to the tables of a folder, each with equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archspark.functions import text as X
from archspark.operators import change, graph, policy, retrieve, risk, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flows(spark: SparkSession, sf: str, when: str = "true") -> DataFrame:
    """Services are nations; each is linked to the two others whose suppliers earn most from its customers."""
    li, o, c, s = (_t(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    sums = li.join(o.where(when), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = sums.where("c_nationkey != s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(revenue.alias("revenue"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("revenue"), "dst"))
    return sums.withColumn("nth", nth).where("nth <= 2").select("src", "dst", "nth", F.round("revenue", 2).alias("revenue"))


def _flows_sql(when: str = "true") -> str:
    return f"""SELECT * FROM (SELECT c_nationkey AS src, s_nationkey AS dst, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, s_nationkey) AS nth
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE c_nationkey <> s_nationkey AND {when} GROUP BY c_nationkey, s_nationkey) WHERE nth <= 2"""


E = _flows_sql()
OLD, NEW = "o_orderdate < '1995-01-01'", "o_orderdate >= '1995-01-01'"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))


@query(f"""WITH e AS ({E}) SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS in_degree, (SELECT count(*) FROM e WHERE src = n_nationkey) AS out_degree,
  (SELECT count(*) FROM e WHERE dst = n_nationkey) > 3 AS bottleneck, (SELECT count(*) FROM e WHERE src = n_nationkey) > 3 AS megaservice FROM nation""")
def g1_service_graph(spark, sf):
    """Service links and coupling labels."""
    return graph.degrees(_nodes(spark, sf), flows(spark, sf), bottleneck=3, megaservice=3)


@query(f"WITH RECURSIVE e AS ({E}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def g1_reachable(spark, sf):
    return graph.reachable(graph.checkpointed(flows(spark, sf).select("src", "dst"))).select("src", "dst")


@query(f"WITH RECURSIVE e AS ({E}), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src WHERE depth < 15) SELECT src, dst, min(depth) AS depth FROM r GROUP BY src, dst")
def g1_bounded_flow(spark, sf):
    return graph.reachable(graph.checkpointed(flows(spark, sf).select("src", "dst")), max_depth=15)


@query(f"""WITH RECURSIVE e AS ({E}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
  m AS (SELECT n_nationkey AS id, least(n_nationkey, coalesce(min(a.dst), n_nationkey)) AS scc FROM nation LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n_nationkey GROUP BY n_nationkey)
  SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size, count(*) OVER (PARTITION BY scc) > 1 AS cyclic FROM m""")
def g1_cyclic_components(spark, sf):
    return graph.components(_nodes(spark, sf), graph.checkpointed(flows(spark, sf).select("src", "dst")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 10 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 10), up AS (
  SELECT p_partkey AS id, p_partkey AS x, 0 AS d FROM part WHERE p_partkey NOT IN (SELECT src FROM e) UNION ALL SELECT src, x, d + 1 FROM up JOIN e ON e.dst = up.id)
  SELECT id, CAST(max(d) AS INTEGER) AS length FROM up WHERE id IN (SELECT p_partkey FROM part) GROUP BY id""")
def g2_longest_chain(spark, sf):
    """Parts call part number div 10."""
    part = _t(spark, sf, "part")
    edges = part.where("p_partkey >= 10").select(F.expr("p_partkey div 10").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.longest_chain(edges, part.select(F.col("p_partkey").alias("id")))


_PART_CALLS = """SELECT p_partkey AS src, 0 AS pos, p_partkey // 10 AS dst FROM part WHERE p_partkey >= 10 UNION ALL SELECT p_partkey, 1, p_partkey // 3 FROM part WHERE p_partkey >= 10"""
_PART_PATHS = f"""RECURSIVE c AS ({_PART_CALLS}), w AS (SELECT p_partkey AS root, p_partkey AS node, CAST([] AS INTEGER[]) AS path FROM part UNION ALL SELECT root, dst, list_append(path, pos) FROM w JOIN c ON node = src),
  v AS (SELECT root, node, min(path) AS path FROM w GROUP BY root, node),
  chain AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position, CAST(len(path) AS INTEGER) AS depth FROM v),
  cyc AS (SELECT root, count(src) > count(DISTINCT node) - 1 AS cycles FROM v LEFT JOIN c ON node = src GROUP BY root)"""


def _part_chain(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey")
    calls = p.where("p_partkey >= 10").select(F.col("p_partkey").alias("src"), F.posexplode(F.array(F.expr("p_partkey div 10"), F.expr("p_partkey div 3"))).alias("pos", "dst"))
    return graph.call_chain(calls, p.select(F.col("p_partkey").alias("id")))


@query(f"WITH {_PART_PATHS} SELECT chain.*, cycles FROM chain JOIN cyc USING (root)")
def g2_call_chain(spark, sf):
    """Every part calls the parts of a tenth and of a third of its number."""
    return _part_chain(spark, sf)


_REQUIRED = "SELECT p_partkey AS node, CASE p_size % 3 WHEN 0 THEN 0 ELSE 1 END AS n FROM part WHERE p_size % 7 <> 0"
_CHAIN_STATS = f"""SELECT root, count(*) AS total, CAST(count(n) AS BIGINT) AS resolved, count(*) - count(n) AS unresolved, max(depth) AS max_depth, count(*) FILTER (n = 0) AS public, count(*) FILTER (n > 0) AS restricted, bool_or(cycles) AS cycles
  FROM chain JOIN cyc USING (root) LEFT JOIN ({_REQUIRED}) USING (node) GROUP BY root"""


@query(f"WITH {_PART_PATHS} {_CHAIN_STATS}")
def g2_chain_statistics(spark, sf):
    roles = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("USER")))
    return graph.chain_statistics(_part_chain(spark, sf), _t(spark, sf, "part").where("p_size % 7 <> 0").select(F.col("p_partkey").alias("node"), roles.alias("roles")))


@query(f"""WITH {_PART_PATHS}, s AS ({_CHAIN_STATS}) SELECT count(*) AS roots, CAST(sum(total) AS BIGINT) AS total, CAST(sum(resolved) AS BIGINT) AS resolved, CAST(sum(unresolved) AS BIGINT) AS unresolved, CAST(count_if(cycles) AS BIGINT) AS with_cycles,
  round_even(avg(total), 2) AS mean_length, min(total) AS min_length, max(total) AS max_length FROM s""")
def g2_corpus_statistics(spark, sf):
    return graph.corpus_statistics(g2_chain_statistics(spark, sf))


@query(f"""WITH RECURSIVE e AS ({E}), r AS (SELECT src AS root, src AS here FROM e UNION SELECT root, e.dst FROM r JOIN e ON here = e.src) SELECT root, src, dst FROM r JOIN e ON here = src""")
def g1_subgraph(spark, sf):
    """All links that a service leads to within 10 steps (which the 25 services don't exceed)."""
    e = graph.checkpointed(flows(spark, sf).select("src", "dst"))
    return graph.subgraph(e, e.select(F.col("src").alias("id")).distinct())


@query(f"""WITH RECURSIVE e AS ({E}), w AS (SELECT DISTINCT src AS src, src AS here, [src] AS nodes FROM e UNION ALL SELECT w.src, e.dst, list_append(nodes, e.dst) FROM w JOIN e ON here = e.src WHERE NOT list_contains(nodes, e.dst) AND len(nodes) <= 4)
  SELECT w.src, here AS dst, array_to_string(nodes, '>') AS nodes FROM w JOIN nation ON here = n_nationkey WHERE n_nationkey % 5 = 0 AND w.src <> here""")
def g1_simple_paths(spark, sf):
    """Paths of at most 4 links to the services whose number five divides."""
    e = graph.checkpointed(flows(spark, sf).select("src", "dst"))
    goals = _nodes(spark, sf).where("id % 5 = 0").select(F.col("id").alias("dst"))
    pairs = e.select("src").distinct().join(F.broadcast(goals), F.col("src") != F.col("dst"))
    return graph.simple_paths(e, pairs, 4).select("src", "dst", F.array_join("nodes", ">").alias("nodes"))


@query(f"WITH e AS ({E}) SELECT src AS id, dst AS other, 'out' AS direction FROM e UNION ALL SELECT dst, src, 'in' FROM e")
def g1_neighbours(spark, sf):
    return graph.neighbours(flows(spark, sf))


@query(f"""WITH RECURSIVE e AS ({E}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), m AS (SELECT DISTINCT a.src, min(least(a.src, a.dst)) OVER (PARTITION BY a.src) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst),
  d AS (SELECT n_nationkey, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS i, (SELECT count(*) FROM e WHERE src = n_nationkey) AS o FROM nation)
  SELECT CAST(count_if(i > 3) AS BIGINT) AS bottlenecks, CAST(count_if(o > 3) AS BIGINT) AS megaservices, CAST(count_if(i + o > 3) AS BIGINT) AS coupled, (SELECT count(DISTINCT scc) FROM m) AS cyclic FROM d""")
def v1_smell_counts(spark, sf):
    return graph.smell_counts(_nodes(spark, sf), graph.checkpointed(flows(spark, sf).select("src", "dst")), 3)


@query(f"WITH s AS (SELECT * FROM ({_flows_sql()})) SELECT src, dst, CASE WHEN nth = 1 THEN 'removed' ELSE 'added' END AS state, CAST(CASE WHEN nth = 1 THEN 0.75 ELSE 0.9 END AS DOUBLE) AS score FROM s")
def c4_critical_impacts(spark, sf):
    """Scores by the rank of the link, those above 0.7."""
    f = flows(spark, sf).select("src", "dst", F.when(F.col("nth") == 1, "removed").otherwise("added").alias("state"), F.when(F.col("nth") == 1, 0.75).otherwise(0.9).alias("score"))
    return change.critical(f)


@query(f"""WITH a AS ({_flows_sql(OLD)}), b AS ({_flows_sql(NEW)}) SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.nth AS before, b.nth AS after,
  CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' WHEN a.nth = b.nth THEN 'unmodified' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""")
def g4_graph_diff(spark, sf):
    return graph.diff(flows(spark, sf, OLD), flows(spark, sf, NEW), ["src", "dst"], "nth")


@query(f"""WITH d AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' WHEN a.nth = b.nth THEN 'unmodified' ELSE 'modified' END AS state
    FROM ({_flows_sql(OLD)}) a FULL JOIN ({_flows_sql(NEW)}) b ON a.src = b.src AND a.dst = b.dst),
  v AS (SELECT s_nationkey AS service, least(1.0, count(*) / 10) AS volatility, 1 + 0.1 * count_if(s_acctbal > 5000) AS c FROM supplier GROUP BY 1)
  SELECT d.src, d.dst, state, round(least(1.0, CASE state WHEN 'removed' THEN 0.75 + 0.25 * coalesce(s.volatility, 0) WHEN 'modified' THEN 0.4 + 0.4 * coalesce(t.volatility, 0) * coalesce(t.c, 1)
    WHEN 'added' THEN 0.3 + 0.3 * coalesce(t.volatility, 0) ELSE CASE WHEN coalesce(t.volatility, 0) > 0 THEN 0.15 + 0.7 * coalesce(t.volatility, 0) * coalesce(t.c, 1) ELSE 0 END END), 2) AS score
  FROM d LEFT JOIN v s ON s.service = d.src LEFT JOIN v t ON t.service = d.dst""")
def g4_impact(spark, sf):
    vol = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("service")).agg(F.least(F.lit(1.0), F.count("*") / 10).alias("volatility"), (1 + 0.1 * F.count_if(F.col("s_acctbal") > 5000)).alias("centrality"))
    return change.impact(g4_graph_diff(spark, sf).select("src", "dst", "state"), vol)


YEARLY = """SELECT DISTINCT year(o_orderdate) AS snapshot, c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"""
PROFILE = f"""WITH e AS ({YEARLY}), d AS (SELECT snapshot, id, count(*) AS d FROM (SELECT snapshot, src AS id FROM e UNION ALL SELECT snapshot, dst FROM e) GROUP BY ALL),
  m AS (SELECT *, avg(d) OVER (PARTITION BY snapshot) AS mean FROM d),
  p AS (SELECT snapshot, count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, CAST(count_if(d > 1.5 * mean) AS BIGINT) AS hubs, CAST(count_if(d <= 1) AS BIGINT) AS leaves FROM m GROUP BY snapshot)
  SELECT *, greatest(0, nodes - hubs - leaves) AS internal, round(edges / nodes, 2) AS coupling, round(edges / (nodes * (nodes - 1)), 3) AS density FROM p"""


@query(PROFILE)
def g1_degree_profile(spark, sf):
    li, o, c, s = (_t(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    big = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.profile(big.select(F.year("o_orderdate").alias("snapshot"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")))


_YEARS = "SELECT o_orderpriority AS key, year(o_orderdate) AS idx, round(sum(o_totalprice), 2) AS y, count(*) AS n FROM orders GROUP BY 1, 2"


def _years(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("idx")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count("*").alias("n"))


@query(f"""WITH s AS ({_YEARS}), f AS (SELECT key, regr_slope(n, idx) AS a, regr_intercept(n, idx) AS b, max(idx) AS last FROM s GROUP BY key HAVING count(*) > 1)
  SELECT key, CAST(last + k AS INTEGER) AS idx, round(greatest(0.0, b + a * (last + k)), 2) AS y FROM f, (SELECT unnest([1, 2, 3]) AS k)""")
def s3_forecast(spark, sf):
    return change.forecast(_years(spark, sf).select("key", "idx", F.col("n").alias("y")))


@query(f"SELECT key, idx, lag(idx) OVER (PARTITION BY key ORDER BY idx) AS previous, round(round(n / 7, 4) * CASE WHEN n % 5 > 0 THEN n % 5 ELSE 1 END, 2) AS risk FROM ({_YEARS})")
def s3_snapshot_deltas(spark, sf):
    return change.deltas(_years(spark, sf).select("key", "idx", F.round(F.col("n") / 7, 4).alias("coupling"), (F.col("n") % 5).alias("affected")))


_CHANGED = """SELECT lower(replace(p_brand, '#', '-')) || '/' || p_type || CASE p_size % 5 WHEN 0 THEN '/Controller.java' WHEN 1 THEN '/pom.xml' WHEN 2 THEN '/OrderServiceImpl.java' WHEN 3 THEN '/OrderRepository.java' ELSE '/README' END AS path,
  CASE p_partkey % 3 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'MODIFY' ELSE 'ADD' END AS change, CASE p_partkey % 4 WHEN 0 THEN ['DELETE', 'ADD'] WHEN 1 THEN ['MODIFY'] ELSE [] END AS components FROM part"""


def _changed(spark, sf):
    name = F.when(F.col("p_size") % 5 == 0, "/Controller.java").when(F.col("p_size") % 5 == 1, "/pom.xml").when(F.col("p_size") % 5 == 2, "/OrderServiceImpl.java").when(F.col("p_size") % 5 == 3, "/OrderRepository.java").otherwise("/README")
    kind = F.when(F.col("p_partkey") % 3 == 0, "DELETE").when(F.col("p_partkey") % 3 == 1, "MODIFY").otherwise("ADD")
    parts = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("DELETE"), F.lit("ADD"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("MODIFY"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf, "part").select(F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("/"), F.col("p_type"), name).alias("path"), kind.alias("change"), parts.alias("components"))


@query(f"""WITH c AS ({_CHANGED}), k AS (SELECT regexp_extract(path, '^/?([^/]+)/', 1) AS service, change, components, CASE WHEN regexp_matches(lower(path), 'pom\\.xml|\\.yml|\\.properties') THEN 5 WHEN regexp_matches(lower(path), 'controller|endpoint') THEN 4
    WHEN regexp_matches(lower(path), 'service|impl') THEN 3 WHEN regexp_matches(lower(path), 'entity|repository') THEN 2 ELSE 1 END AS k FROM c),
  w AS (SELECT service, k * CASE change WHEN 'DELETE' THEN 3.0 WHEN 'MODIFY' THEN 2.0 ELSE 1.0 END + coalesce(list_sum(list_transform(components, lambda x: CASE x WHEN 'DELETE' THEN 1.5 WHEN 'MODIFY' THEN 1.0 ELSE 0.5 END)), 0) AS w,
    unnest([CASE k WHEN 5 THEN 'Config/Infra Changes' WHEN 4 THEN 'API/Contract Changes' WHEN 3 THEN 'Core Logic Overhaul' WHEN 2 THEN 'Data Model Shifts' END, CASE change WHEN 'DELETE' THEN 'Severe Deletions' END]) AS risk FROM k)
  SELECT service, CAST(round(sum(w) / 2, 2) AS DOUBLE) AS raw, CAST(round(least(1.0, sum(w) / 2 / 20), 4) AS DOUBLE) AS volatility, coalesce(string_agg(DISTINCT risk, ',' ORDER BY risk), '') AS risks FROM w GROUP BY service""")
def c4_volatility(spark, sf):
    return change.volatility(_changed(spark, sf))


@query(f"""SELECT CAST(count_if(change = 'ADD') + sum(len(list_filter(components, lambda x: x = 'ADD'))) AS BIGINT) AS added, CAST(count_if(change = 'MODIFY') + sum(len(list_filter(components, lambda x: x = 'MODIFY'))) AS BIGINT) AS modified,
  CAST(count_if(change = 'DELETE') + sum(len(list_filter(components, lambda x: x = 'DELETE'))) AS BIGINT) AS deleted FROM ({_CHANGED})""")
def c4_change_counters(spark, sf):
    return change.counters(_changed(spark, sf))


# --- calls: events of a user are the calls of a method, event types the services
_CALLS = "SELECT user_id AS method, event_id AS pos, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst, event_type, value FROM events"


def _calls(spark, sf):
    return _t(spark, sf, "events").select(F.col("user_id").alias("method"), F.col("event_id").alias("pos"), F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("dst"), "event_type", "value")


@query(f"""WITH c AS ({_CALLS}), x AS (SELECT * FROM c WHERE src <> dst), r AS (SELECT dst AS src, src AS dst, min(pos) AS reverse FROM x GROUP BY 1, 2)
  SELECT method, pos, x.src, x.dst, row_number() OVER (PARTITION BY method ORDER BY pos) AS nth,
    CASE WHEN reverse < pos THEN 'cyclic' WHEN row_number() OVER (PARTITION BY method ORDER BY pos) > 1 THEN 'chatty' ELSE 'none' END AS tag FROM x LEFT JOIN r ON r.src = x.src AND r.dst = x.dst""")
def g3_chatty_calls(spark, sf):
    return graph.chatty(_calls(spark, sf).withColumn("order", F.col("pos")))


@query("""WITH c AS (SELECT user_id AS method, event_id AS pos, CASE WHEN event_type IN ('signup', 'view') THEN event_type END AS target, event_type IN ('purchase', 'click') AS is_rest FROM events),
  s AS (SELECT *, coalesce(sum(CAST(is_rest AS INTEGER)) OVER (PARTITION BY method ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM c)
  SELECT method, pos, meant FROM (SELECT method, pos, is_rest, last_value(target IGNORE NULLS) OVER (PARTITION BY method, stretch ORDER BY pos) AS meant FROM s) WHERE is_rest""")
def g3_pending_targets(spark, sf):
    e = _t(spark, sf, "events")
    return graph.pending_targets(e.select(F.col("user_id").alias("method"), F.col("event_id").alias("pos"), F.when(F.col("event_type").isin("signup", "view"), F.col("event_type")).alias("target"), F.col("event_type").isin("purchase", "click").alias("is_rest")))


_URL_CALLS = "SELECT c_mktsegment AS src, '/api/' || (c_custkey % 40) AS url, 'GET ' || (c_custkey % 7) AS request FROM customer"
_URLS = "SELECT '/api/' || (s_suppkey % 40) AS url, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS service, s_suppkey AS pos FROM supplier"


@query(f"""SELECT src, dst, count(*) AS n_requests, list_sort(list_distinct(list(request))) AS requests FROM ({_URL_CALLS}) JOIN (SELECT url, arg_max(service, pos) AS dst FROM ({_URLS}) GROUP BY url) USING (url) WHERE src <> dst GROUP BY src, dst""")
def g1_links_by_url(spark, sf):
    calls = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("src"), F.concat(F.lit("/api/"), F.col("c_custkey") % 40).alias("url"), F.concat(F.lit("GET "), F.col("c_custkey") % 7).alias("request"))
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "AUTOMOBILE").when(k == 1, "BUILDING").when(k == 2, "FURNITURE").when(k == 3, "MACHINERY").otherwise("HOUSEHOLD")
    return graph.calls_to_links(calls, _t(spark, sf, "supplier").select(F.concat(F.lit("/api/"), F.col("s_suppkey") % 40).alias("url"), name.alias("service"), F.col("s_suppkey").alias("pos")))


# --- policy: customers of a nation form a chain of endpoints; roles and requirements by number
ROLES = ["ADMIN", "MANAGER", "USER"]
_CHAIN = """SELECT c_nationkey AS root, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position, c_custkey AS endpoint,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['ADMIN'] WHEN 3 THEN ['ADMIN', 'USER'] WHEN 4 THEN ['MANAGER'] ELSE ['OTHER'] END AS required FROM customer"""
_MATRIX = f"""SELECT root, position, endpoint, role, CAST(idx AS INTEGER) AS role_idx, CAST(CASE WHEN required IS NULL THEN -1 WHEN len(required) = 0 THEN 1 WHEN base IS NULL THEN -1 WHEN idx + 1 <= base THEN 1 ELSE 0 END AS INTEGER) AS v FROM (
  SELECT *, list_max(list_filter(list_transform(required, lambda r: coalesce(list_position(['ADMIN', 'MANAGER', 'USER'], r), 0)), lambda p: p > 0)) AS base FROM ({_CHAIN}), (SELECT unnest(['ADMIN', 'MANAGER', 'USER']) AS role, unnest([0, 1, 2]) AS idx))"""


def _chain(spark, sf):
    k = F.col("c_custkey") % 6
    arr = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<string>")
    required = F.when(k == 0, None).when(k == 1, arr()).when(k == 2, arr("ADMIN")).when(k == 3, arr("ADMIN", "USER")).when(k == 4, arr("MANAGER")).otherwise(arr("OTHER"))
    position = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long")
    return _t(spark, sf, "customer").select(F.col("c_nationkey").alias("root"), position.alias("position"), F.col("c_custkey").alias("endpoint"), required.alias("required"))


@query(_MATRIX)
def p1_permission_matrix(spark, sf):
    return policy.permission_matrix(_chain(spark, sf), ROLES)


_PAIRS = f"""SELECT * FROM (SELECT root, role, position, CASE WHEN up = v THEN NULL WHEN up = -1 OR v = -1 THEN 'UndefinedPolicy' WHEN up = 1 THEN 'UnderPermissiveDownstream' ELSE 'OverPermissiveDownstream' END AS finding
  FROM (SELECT *, lag(v) OVER (PARTITION BY root, role ORDER BY position) AS up FROM ({_MATRIX})) WHERE up IS NOT NULL) WHERE finding IS NOT NULL"""


@query(_PAIRS)
def p1_pair_findings(spark, sf):
    return policy.pair_findings(p1_permission_matrix(spark, sf))


_SCENARIOS = """SELECT n_nationkey AS root, n_nationkey % 3 AS max_depth, CASE WHEN regexp_matches(lower(n_name), 'pay|refund|payment') THEN 'FINANCIAL' WHEN regexp_matches(lower(n_name), 'user|profile|personal|account') THEN 'PII'
  WHEN regexp_matches(lower(n_name), 'admin|config|manage|report') THEN 'INTERNAL' ELSE 'PUBLIC' END AS sensitivity, n_nationkey % 4 = 0 AS is_public FROM nation"""


@query(f"""WITH f AS (SELECT root, bool_or(finding = 'OverPermissiveDownstream') AS o, bool_or(finding = 'UnderPermissiveDownstream') AS u FROM ({_PAIRS}) GROUP BY root)
  SELECT root, concat_ws('_', CASE WHEN max_depth > 0 THEN 'DOWNSTREAM' ELSE 'ENTRYPOINT' END, CASE WHEN o IS NULL THEN 'CONSISTENT' WHEN o THEN 'OVER_PERMISSIVE' WHEN u THEN 'UNDER_PERMISSIVE' ELSE 'UNDEFINED_POLICY' END,
    sensitivity, CASE WHEN is_public THEN 'PUBLIC' ELSE 'RESTRICTED' END) AS category FROM ({_SCENARIOS}) LEFT JOIN f USING (root)""")
def p1_scenario_category(spark, sf):
    """Scenarios are nations; what counts against them are the findings along their chain."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("root"), (F.col("n_nationkey") % 3).alias("max_depth"), X.sensitivity(F.col("n_name"), transactions=False).alias("sensitivity"), (F.col("n_nationkey") % 4 == 0).alias("is_public"))
    return policy.category(n, p1_pair_findings(spark, sf))


@query(f"SELECT root, role FROM ({_MATRIX}) WHERE position <= 1 GROUP BY root, role HAVING min(v) = 1")
def p1_allowed_throughout(spark, sf):
    """Roles that may call the first two endpoints of a chain."""
    return policy.allowed_throughout(p1_permission_matrix(spark, sf).where("position <= 1"))


@query(f"""SELECT DISTINCT root, role, downstream FROM (SELECT d.root, d.endpoint AS downstream, unnest(list_filter(d.required, lambda r: NOT list_contains(e.required, r))) AS role
  FROM ({_CHAIN}) d JOIN ({_CHAIN}) e ON e.root = d.root AND e.position = 0 WHERE d.position > 0 AND len(d.required) > 0 AND len(e.required) > 0)""")
def p1_restrictive_upstream(spark, sf):
    return policy.restrictive_upstream(_chain(spark, sf))


@query(f"""SELECT root, endpoint, coalesce(string_agg(role, ',' ORDER BY role) FILTER (v = 1), '') AS allowed, coalesce(string_agg(role, ',' ORDER BY role) FILTER (v = 0), '') AS denied,
  coalesce(string_agg(role, ',' ORDER BY role) FILTER (v = -1), '') AS unknown, bool_and(v = -1) AS is_public, round(count_if(v = 1) / count(*), 4) AS grant_rate FROM ({_MATRIX}) GROUP BY root, endpoint""")
def p1_permission_summary(spark, sf):
    return policy.summary(p1_permission_matrix(spark, sf))


_MASKED = "SELECT o_custkey AS name, CAST(bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS INTEGER) AS mask FROM orders GROUP BY 1"


@query(f"""WITH e AS ({_MASKED}), l AS (SELECT DISTINCT o_custkey AS caller, o_custkey // 2 AS callee FROM orders)
  SELECT c.name AS a, d.name AS b, 'caller_not_in_callee' AS rule FROM l JOIN e c ON c.name = caller JOIN e d ON d.name = callee WHERE (c.mask & ~d.mask) <> 0""")
def p2_role_violations(spark, sf):
    o = _t(spark, sf, "orders")
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    masks = o.groupBy(F.col("o_custkey").alias("name")).agg(F.bit_or(bit).alias("mask"))
    return policy.violations(masks, o.select(F.col("o_custkey").alias("caller"), F.expr("o_custkey div 2").alias("callee")))


@query(f"SELECT CASE mask WHEN 0 THEN 'None' WHEN 1 THEN 'Unauthenticated' WHEN 2 THEN 'User Only' WHEN 4 THEN 'Admin Only' WHEN 6 THEN 'User + Admin Only' WHEN 7 THEN 'Any Authenticated User' ELSE CAST(mask AS VARCHAR) END AS role, count(*) AS n FROM ({_MASKED}) GROUP BY 1")
def p2_role_labels(spark, sf):
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    masks = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("mask"))
    return masks.groupBy(policy.role_label(F.col("mask")).alias("role")).agg(F.count("*").alias("n"))


_TOUCHES = "SELECT o_custkey AS endpoint, l_partkey AS repo, CAST(bit_or(CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 4 ELSE 2 END) AS INTEGER) AS ops FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


@query(f"""WITH e AS ({_MASKED}), t AS ({_TOUCHES}), l AS (SELECT DISTINCT o_custkey AS caller, o_custkey // 2 AS callee FROM orders), r AS (SELECT unnest([1, 2, 4]) AS role),
  d AS (SELECT DISTINCT caller AS e2, role FROM l JOIN e ON name = callee, r WHERE mask & role = 0),
  b AS (SELECT role, x.repo, x.endpoint AS e1, y.endpoint AS e2 FROM r, t x JOIN t y ON x.repo = y.repo JOIN e a ON a.name = x.endpoint JOIN e c ON c.name = y.endpoint
    WHERE a.mask & role > 0 AND c.mask & role = 0 AND x.ops & y.ops = y.ops AND (y.endpoint, role) NOT IN (SELECT e2, role FROM d))
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM t x JOIN t y ON x.repo = y.repo WHERE x.endpoint = b.e1 AND y.endpoint = b.e2 AND x.repo <> b.repo AND x.ops & y.ops <> y.ops)""")
def p2_data_consistency(spark, sf):
    """Endpoints are customers, repositories parts."""
    o = _t(spark, sf, "orders")
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    op = F.when(F.col("l_returnflag") == "A", 8).when(F.col("l_returnflag") == "N", 4).otherwise(2)
    touches = o.join(_t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("endpoint"), F.col("l_partkey").alias("repo"), op.alias("ops"))
    links = o.select(F.col("o_custkey").alias("caller"), F.expr("o_custkey div 2").alias("callee"))
    return policy.inconsistent_touches(o.groupBy(F.col("o_custkey").alias("name")).agg(F.bit_or(bit).alias("mask")), touches, links, [1, 2, 4])


# --- risk: each event is a finding about its user
_OPINIONS = """SELECT user_id AS endpoint, event_id AS pos, CASE event_type WHEN 'purchase' THEN c WHEN 'click' THEN 0 ELSE (1 - c) / 2 END AS b, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN c ELSE (1 - c) / 2 END AS d,
  CASE WHEN event_type IN ('purchase', 'click') THEN 1 - c ELSE c END AS u FROM (SELECT *, 0.1 + 0.8 * (event_id % 9) / 10 AS c FROM events)"""
_FUSED = f"SELECT endpoint, r / (1 + r + s) AS b, s / (1 + r + s) AS d, 1 / (1 + r + s) AS u FROM (SELECT endpoint, sum(b / u) AS r, sum(d / u) AS s FROM ({_OPINIONS}) GROUP BY endpoint)"


def _fused(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "risk-decreasing").when(F.col("event_type") == "click", "risk-increasing").otherwise("unsure")
    o = _t(spark, sf, "events").select(F.col("user_id").alias("endpoint"), F.col("event_id").alias("pos"), risk.finding_opinion(kind, 0.1 + 0.8 * (F.col("event_id") % 9) / 10).alias("o"))
    return risk.fuse(o.select("endpoint", "pos", "o.*"), "endpoint")


@query(f"SELECT endpoint, round(b, 6) AS b, round(d, 6) AS d, round(u, 6) AS u, round(b + 0.5 * u, 6) AS expectation FROM ({_FUSED})")
def r1_fused_opinions(spark, sf):
    return _fused(spark, sf).select("endpoint", *(F.round(x, 6).alias(x) for x in "bdu"), F.round(risk.expectation(F.col("b"), F.col("u")), 6).alias("expectation"))


@query(f"SELECT count(*) AS n, round(avg(b + 0.5 * u), 3) AS mean_expectation, CAST(count_if(b + 0.5 * u < 0.3) AS BIGINT) AS critical, CAST(count_if(b > 0.3 AND d > 0.3) AS BIGINT) AS conflict FROM ({_FUSED})")
def r1_dashboard(spark, sf):
    return risk.dashboard(_fused(spark, sf))


@query("""WITH k AS (SELECT r_regionkey + 1 AS i FROM region), m AS (SELECT a.i, b.i AS j, CASE WHEN a.i < b.i THEN b.i - a.i + 1.0 WHEN a.i = b.i THEN 1.0 ELSE 1.0 / (a.i - b.i + 1) END AS v FROM k a, k b),
  t AS (SELECT j, sum(v) AS total FROM m GROUP BY j), w AS (SELECT i, avg(v / total) AS w FROM m JOIN t USING (j) GROUP BY i), l AS (SELECT sum(w * total) AS x FROM w JOIN t ON i = j)
  SELECT CAST(i AS INTEGER) AS i, round(w, 6) AS w, round(x, 6) AS lambda_max, round((x - 5) / 4, 6) AS ci, round((x - 5) / 4 / 1.12, 6) AS cr FROM w, l""")
def r2_ahp_weights(spark, sf):
    i = _t(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("int").alias("i"))
    cells = i.select("i", F.explode(F.sequence(F.col("i"), F.lit(5))).alias("j")).where("i < j").select("i", "j", (F.col("j") - F.col("i") + 1.0).alias("v"))
    return risk.ahp(cells, 5)


# --- URLs
@query(r"""WITH p AS (SELECT page_id, CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') ELSE q END AS path, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM (
    SELECT page_id, url, regexp_replace('/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g') AS q FROM pages))
  SELECT page_id, path, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-zA-Z0-9]{8,}(-[a-zA-Z0-9]+)*)$') THEN '{id}' ELSE s END), '/') AS template,
    substr(sha256(regexp_replace(regexp_replace(lower(host), '[-_]', '', 'g'), '^(ts|ms|svc)', '') || ':' || path || ':GET'), 1, 32) AS endpoint_id FROM p""")
def t2_endpoint_ids(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url", X.url_path(F.col("url")).alias("path"), F.regexp_extract("url", "//([^/?#]+)", 1).alias("host"))
    return p.select("page_id", "path", X.templated(F.col("path")).alias("template"), X.endpoint_id(F.col("host"), F.col("url"), F.lit("get")).alias("endpoint_id"))


_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/$', '')"


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), t AS (SELECT unnest(['/en/{{?}}', '/de/{{?}}', '/{{?}}/{{?}}', '/EN/7']) AS template)
  SELECT path, (SELECT template FROM t WHERE len(string_split(path, '/')) = len(string_split(template, '/')) AND regexp_full_match(path, '(?i)' || replace(template, '{{?}}', '[A-Za-z0-9._-]{{1,200}}'))
    ORDER BY len(list_filter(string_split(template, '/'), lambda s: s <> '{{?}}')) DESC, template LIMIT 1) AS template FROM p""")
def t2_template_match(spark, sf):
    templates = spark.createDataFrame([("/en/{?}",), ("/de/{?}",), ("/{?}/{?}",), ("/EN/7",)], "template string")
    return retrieve.match_templates(_t(spark, sf, "pages").select(X.url_path(F.col("url")).alias("path")), templates)


RULES = [("web", "/en/**", None, "user", 0), ("web", "/en/*", "GET", "guest", 1), ("web", "/**", None, "deny", 2), ("web", "/de/{id}", None, "admin", 3), ("web", "/fr/8?", None, "fr", 4)]


@query(rf"""WITH e AS (SELECT DISTINCT 'web' AS service, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, {_PATH} AS uri FROM pages),
  r AS (SELECT unnest(['/en/**', '/en/*', '/**', '/de/{{id}}', '/fr/8?']) AS pattern, unnest(['^/en(/.*)?$', '^/en/[^/]*$', '^(/.*)?$', '^/de/[^/]+$', '^/fr/8[^/]$']) AS re, unnest([NULL, 'GET', NULL, NULL, NULL]) AS m,
    unnest(['user', 'guest', 'deny', 'admin', 'fr']) AS decision, unnest([720, 800, 700, 900, 800]) AS spec, unnest([0, 1, 2, 3, 4]) AS pos)
  SELECT service, method, uri, coalesce(arg_min(decision, -spec * 10 + pos), 'none') AS decision, arg_min(pattern, -spec * 10 + pos) AS pattern FROM e LEFT JOIN r ON regexp_matches(uri, re) AND (m IS NULL OR m = method) GROUP BY ALL""")
def t2_security_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "service string, pattern string, http_method string, decision string, pos int")
    e = _t(spark, sf, "pages").select(F.lit("web").alias("service"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), X.url_path(F.col("url")).alias("uri")).distinct()
    return retrieve.apply_rules(e, rules)


# --- text
@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'pay|refund|payment|transaction') THEN 'FINANCIAL' WHEN regexp_matches(lower(text), 'user|profile|personal|account') THEN 'PII'
    WHEN regexp_matches(lower(text), 'admin|config|manage|report') THEN 'INTERNAL' ELSE 'PUBLIC' END AS sensitivity,
  len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+')) AS n_emails, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS n_keys,
  CASE WHEN n_chars = 0 THEN 'none' WHEN least(1.0, n_chars / 10000) < 0.3 THEN 'low' WHEN least(1.0, n_chars / 10000) < 0.6 THEN 'medium' WHEN least(1.0, n_chars / 10000) < 0.8 THEN 'high' ELSE 'critical' END AS band FROM documents""")
def t1_sensitivity(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)).alias
    return _t(spark, sf, "documents").select("doc_id", X.sensitivity(F.col("text")).alias("sensitivity"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+")("n_emails"), n("AKIA[0-9A-Z]{16}")("n_keys"), X.band(F.least(F.lit(1.0), F.col("n_chars") / 10000)).alias("band"))


# --- retrieval
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_/{{}}-]+'), lambda t: t <> '')"
_EVIDENCE = """SELECT doc_id AS id, text, source AS entity, lang AS service, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 5 WHEN 'fr' THEN 3 ELSE 0 END AS rank, CASE WHEN doc_id % 2 = 0 THEN 0.9 + (doc_id % 100) / 1000 WHEN doc_id % 3 = 0 THEN 0.15 ELSE 0 END AS recency FROM documents"""
_RANKED = f"""WITH e0 AS ({_EVIDENCE}), q AS (SELECT item_id AS query, token, count(*) AS n FROM (SELECT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark) GROUP BY ALL),
  risky AS (SELECT item_id AS query, regexp_matches(lower(text), 'risk|smell|anti-pattern|antipattern|bottleneck|cycle|coupled|architecture issue') AS risky FROM benchmark),
  e AS (SELECT id, unnest(list_distinct({_TOK.format('text')})) AS token, 1.2 AS w FROM e0 UNION ALL SELECT id, unnest(list_distinct({_TOK.format("entity || ' ' || service")})), 1.8 FROM e0),
  m AS (SELECT query, id, CAST(sum(n * w) AS DOUBLE) AS s FROM q JOIN e USING (token) GROUP BY query, id),
  a AS (SELECT query, id, rank, round(coalesce(s, 0) + CAST(0.3 * rank + recency AS DOUBLE) + CASE WHEN risky AND regexp_matches(lower(text || ' ' || entity), 'anti-pattern|antipattern|bottleneck|cyclic|megaservice|coupling') THEN 3.0 ELSE 0.0 END, 4) AS score
    FROM (SELECT * FROM risky, e0) LEFT JOIN m USING (query, id))
  SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank DESC, id) AS place FROM a) WHERE place <= 20"""


def _evidence(spark, sf):
    d, k = _t(spark, sf, "documents"), F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "ENDPOINT").when(F.col("lang") == "de", "SERVICE").when(F.col("lang") == "fr", "ARCHITECTURE").otherwise("OTHER")
    ts = F.when(k % 2 == 0, F.timestamp_millis((900_000_000_000 + (k % 100) * 1_000_000_000).cast("long")))
    return d.select(k.alias("id"), kind.alias("kind"), "text", F.lit("DOC").alias("entity_type"), F.col("source").alias("entity"), F.col("lang").alias("service"), F.lit(None).cast("string").alias("path"), ts.alias("ts"), F.when(k % 3 == 0, "1.0.0").alias("version"), F.lit("").alias("location"))


@query(_RANKED)
def q1_ranked_evidence(spark, sf):
    """The 20 best documents for every benchmark item."""
    return retrieve.ranked(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text"), _evidence(spark, sf))


_BUDGETED = f"""WITH RECURSIVE b AS (SELECT query, r.place - 1 AS place, r.id, CASE lang WHEN 'en' THEN 'ENDPOINT' WHEN 'de' THEN 'SERVICE' WHEN 'fr' THEN 'ARCHITECTURE' ELSE 'OTHER' END AS kind, n_chars, r.id % 17 = 0 AS direct,
    CASE WHEN r.id % 3 = 0 THEN -100 ELSE 100 END AS said, CASE query % 3 WHEN 0 THEN CASE lang WHEN 'en' THEN 10 WHEN 'de' THEN 5 ELSE 1 END WHEN 1 THEN CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 6 WHEN 'fr' THEN 7 ELSE 1 END ELSE CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 6 ELSE 1 END END AS p
    FROM ({_RANKED}) r JOIN documents ON doc_id = r.id),
  o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY 10000 - place + said + 10 * p DESC, p DESC, CAST(id AS VARCHAR), place) - 1 AS ord FROM b),
  f AS (SELECT query, min(ord) FILTER (direct) AS first, arg_min(n_chars, ord) FILTER (direct) AS first_chars FROM o GROUP BY query),
  g AS (SELECT query, CAST(-1 AS BIGINT) AS ord, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS items, coalesce(first_chars, 0) AS chars, false AS kept FROM f UNION ALL
    SELECT o.query, o.ord, items + CASE WHEN o.ord IS DISTINCT FROM first AND items < 20 AND chars + n_chars <= 12000 THEN 1 ELSE 0 END, chars + CASE WHEN o.ord IS DISTINCT FROM first AND items < 20 AND chars + n_chars <= 12000 THEN n_chars ELSE 0 END,
      o.ord IS NOT DISTINCT FROM first OR (items < 20 AND chars + n_chars <= 12000) FROM g JOIN f USING (query) JOIN o ON o.query = g.query AND o.ord = g.ord + 1)
  SELECT o.query, o.ord AS "order", place, id, kind, n_chars, kept, NOT bool_and(kept) OVER (PARTITION BY o.query) AS truncated FROM o JOIN g ON o.query = g.query AND o.ord = g.ord"""


@query(_BUDGETED)
def q1_budgeted_evidence(spark, sf):
    """What of that fits into 20 items and 12,000 characters, with what is left out; questions of three intents, direct matches by number."""
    d, k = _t(spark, sf, "documents"), F.col("id")
    kinds = _evidence(spark, sf).select("id", "kind", "location").join(d.select(F.col("doc_id").alias("id"), "n_chars"), "id")
    intent = F.when(F.col("query") % 3 == 0, "ENDPOINT_LOOKUP").when(F.col("query") % 3 == 1, "DEPENDENCY").otherwise("GENERAL")
    return retrieve.budgeted(q1_ranked_evidence(spark, sf).withColumn("place", F.col("place") - 1).join(kinds, "id").select("*", intent.alias("intent"), (k % 3 == 0).alias("inferred"), (k % 17 == 0).alias("direct")))


@query(r"""SELECT CASE WHEN trim(q) = '' THEN 'UNSUPPORTED_SPECULATIVE' WHEN regexp_matches(q, 'topology|system architecture|system design|component diagram') OR regexp_matches(q, '\b(how many|count|number of|list|show)\s+(micro\s*services?|microservices?|services?)\b') THEN 'ARCHITECTURE_TOPOLOGY'
  WHEN regexp_matches(q, 'depends on|what depends|transitive|call') THEN 'DEPENDENCY' WHEN regexp_matches(q, '\b(get|post|put|patch|delete)\s+(/[a-z0-9_\-/{}]+)') OR regexp_matches(q, 'endpoint|url|route') THEN 'ENDPOINT_LOOKUP'
  WHEN q LIKE '%service%' THEN 'SERVICE_LOOKUP' WHEN regexp_matches(q, 'architecture|system|component') THEN 'ARCHITECTURE_TOPOLOGY' ELSE 'UNSUPPORTED_SPECULATIVE' END AS intent, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM (SELECT conv_id, lower(text) AS q FROM conversations WHERE role = 'user') GROUP BY 1""")
def c1_question_intents(spark, sf):
    asked = _t(spark, sf, "conversations").where("role = 'user'")
    return asked.groupBy(retrieve.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


@query("SELECT source, lang, count(*) AS n, grouping(source) AS all_sources, grouping(lang) AS all_langs FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def q1_evidence_census(spark, sf):
    """Counts per source and type, per source, per type, and of all, in one pass."""
    c = _t(spark, sf, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.grouping("source").cast("long").alias("all_sources"), F.grouping("lang").cast("long").alias("all_langs"))
    return c


# --- store and state
@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def s1_latest_per_key(spark, sf):
    return store.latest(_t(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def s1_page(spark, sf):
    return store.page(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 50)


@query("""SELECT name, concat_ws('.', a, b, c) AS latest, concat_ws('.', a, b, c + 1) AS patch, concat_ws('.', a, b + 1, 0) AS minor, concat_ws('.', a + 1, 0, 0) AS major FROM (
  SELECT p_brand AS name, unnest(max([p_size % 12, p_partkey % 11, p_partkey % 13])[1:1]) AS a, max([p_size % 12, p_partkey % 11, p_partkey % 13])[2] AS b, max([p_size % 12, p_partkey % 11, p_partkey % 13])[3] AS c FROM part GROUP BY p_brand)""")
def s1_next_versions(spark, sf):
    return store.next_versions(_t(spark, sf, "part").select(F.col("p_brand").alias("name"), F.concat_ws(".", F.col("p_size") % 12, F.col("p_partkey") % 11, F.col("p_partkey") % 13).alias("version")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def s1_retention(spark, sf):
    o = _t(spark, sf, "orders").withColumn("version", F.when(F.col("o_orderstatus") == "F", "1.0.0"))
    return store.retained(o, "version", "o_orderdate", F.expr("TIMESTAMP_NTZ '1998-01-01'")).select("o_orderkey")


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) o FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) n ON n.k = o.k")
def s1_upsert(spark, sf):
    old = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return store.upsert(old, _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")), ["k"])


@query("""SELECT user_id AS visitor, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS n_visits, arg_max(event_type, event_id) FILTER (event_type NOT IN ('view') AND event_id % 3 <> 0) AS answer FROM events GROUP BY user_id""")
def s2_visits(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("visitor"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("skipped"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("answer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = store.visits(e.select("visitor", "ts", "seq", "skipped", "answer")).select("visitor", "n_visits", "answer")
    times = e.groupBy("visitor").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return out.join(times, "visitor").select("visitor", "first_us", "last_us", "n_visits", "answer")


@query("SELECT event_id AS id, user_id AS ip, count(*) OVER w - 1 AS prior, count(*) OVER w - 1 >= 1 AS rejected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def s2_rate_limit(spark, sf):
    return store.rate_limited(_t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ip"), "ts"), limit=1)


@query("""WITH a AS (SELECT user_id AS id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id AS id, max(ts) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT id, round((epoch_us(e) - epoch_us(s)) / 1e6, 2) AS seconds, e IS NOT NULL AS ended FROM a LEFT JOIN b USING (id)""")
def s2_sessions(spark, sf):
    e = _t(spark, sf, "events")
    return store.sessions(e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("ts")), e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("ts")))


@query("""WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1), u AS (SELECT day, round(100 * sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) / 5e7, 4) AS percent FROM d)
  SELECT strftime(day, '%Y-%m-%d') AS day, percent, CAST(greatest(1, least(CASE WHEN percent >= 90 THEN 1 WHEN percent >= 75 THEN 20 WHEN percent >= 50 THEN 50 WHEN percent >= 0 THEN 100 ELSE 80 END, 80)) AS INTEGER) AS capacity FROM u""")
def s3_budget_steps(spark, sf):
    spend = _t(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))
    steps = spark.createDataFrame([(0, 100), (50, 50), (75, 20), (90, 1)], "at_percent int, capacity int")
    return store.budget_step(spend, steps, 5e7, 80).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "percent", "capacity")


# --- view-level graphs
@query(f"""WITH f AS ({_flows_sql()}), b AS (SELECT src AS id, dst AS other FROM f UNION SELECT dst, src FROM f)
  SELECT id, count(*) AS neighbours, CASE WHEN count(*) > 4 THEN 'red' WHEN count(*) > 2 THEN 'orange' ELSE 'green' END AS colour FROM b GROUP BY id""")
def v1_coupling_colours(spark, sf):
    return graph.coupling(flows(spark, sf), 4)


@query("SELECT DISTINCT l_suppkey AS service, l_partkey AS name FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def v1_shared_imports(spark, sf):
    return graph.shared_imports(_t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("service"), F.col("l_partkey").alias("name")))


@query("""WITH a AS (SELECT o_custkey AS id, min(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS id, max(o_orderkey) AS version FROM orders GROUP BY 1)
  SELECT id, version FROM a UNION ALL SELECT id, version FROM b WHERE id NOT IN (SELECT id FROM a)""")
def v1_timeline_append(spark, sf):
    o = _t(spark, sf, "orders")
    done = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("version"))
    return store.append_new(done, o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("version")), ["id"])
