"""Hand-computed cases."""

import json

import pytest
from pyspark.sql import functions as F

from archspark.functions import text as X
from archspark.operators import change, graph, policy, risk, store


def test_cyclic_and_bottleneck_graphs(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "B"), ("D", "E"), ("E", "D")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    assert {r.id: (r.scc, r.cyclic) for r in graph.components(n, e).collect()} == {"A": ("A", False), "B": ("B", True), "C": ("B", True), "D": ("D", True), "E": ("D", True)}
    assert {r.id: r.in_degree for r in graph.degrees(n, e).collect()} == {"A": 0, "B": 2, "C": 1, "D": 1, "E": 1}
    assert {r.dst for r in graph.reachable(e, spark.createDataFrame([("A",)], "id string")).collect()} == {"B", "C"}


def test_components_and_chains_of_random_graphs(spark):
    """Against plain closures and an enumeration of all paths that take no edge twice."""
    import random

    random.seed(5)
    for n, m in ((12, 9), (14, 16), (30, 45)):
        edges = sorted({(random.randrange(n), random.randrange(n)) for _ in range(m)})
        df = spark.createDataFrame(edges, "src int, dst int")
        reach = {v: set() for v in range(n)}
        for v in range(n):
            todo = [v]
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b not in reach[v]:
                        reach[v].add(b)
                        todo.append(b)
        ids = spark.createDataFrame([(v,) for v in range(n)], "id int")
        got = {r.id: (r.scc, r.size, r.cyclic) for r in graph.components(ids, df).collect()}
        scc = {v: min([v, *(w for w in reach[v] if v in reach[w])]) for v in range(n)}
        assert got == {v: (c, list(scc.values()).count(c), list(scc.values()).count(c) > 1) for v, c in scc.items()}
        if n > 14:
            continue
        leaves = {b for _, b in edges} - {a for a, _ in edges}

        def longest(v, used):
            return max([0 if v in leaves else -(10**6), *(1 + longest(b, used | {(a, b)}) for a, b in edges if a == v and (a, b) not in used)])

        assert {r.id: r.length for r in graph.longest_chain(df, ids).collect()} == {v: max(0, longest(v, frozenset())) for v in range(n)}


def test_longest_chain_of_a_long_line_is_whole(spark):
    df = spark.range(30).selectExpr("id as src", "id + 1 as dst")
    assert {r.id: r.length for r in graph.longest_chain(df, spark.range(31)).collect()} == {i: 30 - i for i in range(31)}


def test_longest_chain_takes_no_edge_twice(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("x", "x")], "src string, dst string")
    n = spark.createDataFrame([("r",), ("x",), ("q",)], "id string")
    assert {r.id: r.length for r in graph.longest_chain(e, n).collect()} == {"r": 2, "x": 0, "q": 0}


@pytest.mark.parametrize(("role", "required", "v"), [("USER", ["ADMIN"], 0), ("USER", ["ADMIN", "USER"], 1), ("ADMIN", ["USER"], 1), ("USER", None, -1), ("USER", [], 1), ("USER", ["X"], -1), ("NOBODY", ["USER"], -1)])
def test_check_access(spark, role, required, v):
    df = spark.createDataFrame([(role, required)], "role string, required array<string>")
    assert df.select(policy.check_access(F.col("role"), F.col("required"), ["ADMIN", "USER"])).first()[0] == v


def test_pair_findings(spark):
    m = spark.createDataFrame([("r", "USER", 0, 1), ("r", "USER", 1, 0), ("r", "USER", 2, 1), ("r", "USER", 3, -1)], "root string, role string, position int, v int")
    assert [r.finding for r in policy.pair_findings(m).orderBy("position").collect()] == ["UnderPermissiveDownstream", "OverPermissiveDownstream", "UndefinedPolicy"]


def test_fusion(spark):
    o = spark.createDataFrame([("e", 0, 0.1, 0.6, 0.3), ("e", 1, 0.85, 0.03, 0.12), ("s", 1, 0.5, 0.5, 0.0), ("s", 0, 0.2, 0.2, 0.6), ("s", 2, 1.0, 0.0, 0.0)], "k string, pos int, b double, d double, u double")
    got = {r.k: (r.b, r.d, r.u) for r in risk.fuse(o, "k").collect()}
    assert got["e"] == pytest.approx((0.695313, 0.210938, 0.09375), abs=1e-6) and got["s"] == (0.5, 0.5, 0.0)


def test_metric_opinion(spark):
    df = spark.createDataFrame([(5.0,), (3.0,), (99.0,)], "v double").select(risk.metric_opinion(F.col("v"), 3, 6, 0.1659805).alias("o"))
    assert [r.o.d for r in df.collect()] == pytest.approx([0.110654, 0.0, 0.1659805], abs=1e-6)


def test_forecast_and_volatility(spark):
    s = spark.createDataFrame([("up", i, y) for i, y in enumerate([2.0, 4.0, 6.0])] + [("down", i, y) for i, y in enumerate([5.0, 3.0, 1.0])] + [("one", 0, 1.0)], "key string, idx int, y double")
    got = {}
    for r in change.forecast(s).orderBy("key", "idx").collect():
        got.setdefault(r.key, []).append(r.y)
    assert got == {"up": [8.0, 10.0, 12.0], "down": [0.0, 0.0, 0.0]}
    c = spark.createDataFrame([("x/src/OrderController.java", "MODIFY", None), ("x/pom.xml", "DELETE", None), ("README", "ADD", None), ("/y/a/Impl.java", "ADD", ["DELETE", "ADD"])], "path string, change string, components array<string>")
    got = {r.service: (r.raw, r.volatility, r.risks) for r in change.volatility(c).collect()}
    assert got == {"x": (23.0, 1.0, "API/Contract Changes,Config/Infra Changes,Severe Deletions"), "y": (5.0, 0.25, "Core Logic Overhaul")}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.clean_url(F.lit("api//v1/x/"))) == "/api/v1/x" and one(X.clean_url(F.lit(""))) == "/"
    ids = [one(X.endpoint_id(F.lit("ts-order-service"), F.lit(u), F.lit("get"))) for u in ("/orders/{?}", "/orders/{?}/items")]
    assert ids[0] != ids[1]
    assert len({one(X.endpoint_id(F.lit("s"), F.lit(u), F.lit("get"), compat=True)) for u in ("/orders/{?}", "/orders/{?}/items")}) == 1  # what compat reproduces
    for pattern, score in (("/api/x", 1000), ("/api/{id}", 900), ("/api/*", 800), ("/api/**", 720), ("/**", 700), ("/api/{id}/**", 900), ("/a/b/**", 730), ("/a?", 800)):
        assert one(X.ant_specificity(F.lit(pattern))) == score
    hit = lambda p, u: one(F.lit(u).rlike(one(X.ant_regex(F.lit(p)))))
    assert hit("/api/**", "/api") and hit("/api/**", "/api/x/y") and not hit("/api/**", "/apix") and hit("/a/*/c", "/a/b/c") and not hit("/a/*/c", "/a/b/b/c")
    assert one(X.cyclomatic(F.lit('if (a && b) { /* if */ for(;;) s = "while"; } // if'))) == 4
    assert one(X.secrets(F.lit("${DB_PASSWORD:s3cretvalue} ${HOST:localhost} ${X:short}"))) == ["s3cretvalue", "localhost"]
    assert one(X.secrets(F.lit("${DB_9:s3cretvalue} ${A:password} ${B:adminadmin}"))) == ["s3cretvalue", "adminadmin"]
    assert one(X.secrets(F.lit("'longsecret$x'"), F.lit("api.key"))) == ["longsecret"] and one(X.secrets(F.lit("longsecret"), F.lit("name"))) == []
    assert one(X.templated(F.lit("/a/12/5f2b8c1d-aaaa-bbbb-cccc-0123456789ab/abc123def456/users"))) == "/a/{id}/{id}/{id}/users"
    assert [one(policy.role_label(F.lit(m))) for m in (0, 1, 2, 3, 4, 6, 7)] == ["None", "Unauthenticated", "User Only", "3", "Admin Only", "User + Admin Only", "Any Authenticated User"]
    assert one(X.cyclomatic(F.lit("do { x = a ? b : c; } while (y);"))) == 3 and one(X.sensitivity(F.lit("/refund"))) == "FINANCIAL"
    assert one(X.injectable(F.lit("findByAAndB"))) and one(X.injectable(F.lit("deleteByName"))) and not one(X.injectable(F.lit("deleteById")))
    urls = {"/api/v1/orderservice/order": "ts-order-service", "/orderservice/order": "ts-order-service", "/api/v1/orderOtherService": "ts-order-other-service", "/api/v1/users/3": "ts-user-service", "/api/v1/foo/3": None, "http://ts-order-service:80/x": None, "": None}
    assert {u: one(X.service_of_url(F.lit(u))) for u in urls} == urls
    assert [one(X.operation_type(F.lit(n))) for n in ("findAll", "addOne", "setX", "existsBy", "modifyAll", "FindX")] == ["SELECT", "UNKNOWN", "UNKNOWN", "SELECT", "UPDATE", "UNKNOWN"]
    assert [one(X.operation_type(F.lit("findAll"), F.lit(q))) for q in (" delete from x", "from X", "call y", None)] == ["DELETE", "SELECT", "UNKNOWN", "SELECT"]
    assert one(X.display_name(F.lit("ts-order-service"))) == "order" and one(X.operation_type(F.lit("findAll"))) == "SELECT"


def test_violations_against_brute_force(spark):
    masks, links = {"a": 2, "b": 4, "c": 6, "d": 0}, [("a", "b"), ("a", "c"), ("d", "a"), ("c", "a")]
    got = {(r.a, r.b, r.rule) for r in policy.violations(spark.createDataFrame(list(masks.items()), "name string, mask int"), spark.createDataFrame(links, "caller string, callee string")).collect()}
    assert got == {("d", None, "no_role")} | {(x, y, "caller_not_in_callee") for x, y in links if masks[x] & ~masks[y]}


def test_visits_keep_answers(spark):
    e = spark.createDataFrame([("v", 1, 1, False, "DE"), ("v", 2, 2, True, "FR"), ("v", 3, 3, False, None)], "visitor string, ts int, seq int, skipped boolean, country string")
    assert tuple(store.visits(e).first()) == ("v", 1, 3, 3, "DE")


def test_ir_documents_files_and_payloads(spark, tmp_path):
    """Two services, one controller of one endpoint and one helper: three rows of evidence; files plain and gzipped, payloads as bytes, base64 and $binary."""
    import base64
    import gzip
    import json

    from archspark.sources import ir as IR

    methods = [{"id": "1", "name": "create", "httpMethod": "POST", "url": "/api/v1/seatservice/seats", "annotations": [{"name": "PreAuthorize"}]}, {"id": "2", "name": "help", "httpMethod": None}, {"name": "no id"}]
    doc = {"name": "sys", "commitID": "c", "more": 1, "microservices": [{"name": "seat", "path": "p", "controllers": [{"name": "SeatController", "methods": methods}]}, {"name": "other"}, {"path": "no name"}]}
    text = json.dumps(doc)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("a.json", "b.json.gz"):
        rows = IR.evidence_rows(IR.read_ir(spark, str(tmp_path / name)), "v1").orderBy("place").collect()
        assert [(r.service, r.entity) for r in rows] == [("seat", "seat"), ("seat", "SeatController.create"), ("other", "other")]
        assert "1 controller(s) exposing 1 HTTP" in rows[0].content and "0 controller(s)" in rows[2].content and (rows[1].http_method, rows[1].url) == ("POST", "/api/v1/seatservice/seats")
    ir = IR.read_ir(spark, str(tmp_path / "a.json"))
    assert [(r.method_id, r.name) for r in IR.annotations(ir).collect()] == [("1", "PreAuthorize")] and IR.methods(ir).count() == 2
    assert IR.evidence_rows(ir, "v1", 2).count() == 2 and IR.evidence_rows(ir, "v1", endpoints=False).count() == 2
    zipped = gzip.compress(text.encode())
    blobs = [zipped, base64.b64encode(zipped), json.dumps({"$binary": {"base64": base64.b64encode(zipped).decode()}}).encode(), text.encode(), b"junk", None]
    got = IR.decoded(spark.createDataFrame(list(enumerate(blobs)), "id int, payload binary")).orderBy("id").collect()
    assert [r.name for r in got] == ["sys"] * 4 + [None] * 2
    IR.write_json(ir, str(tmp_path / "out"))
    assert IR.services(spark.read.schema(IR.IR).json(str(tmp_path / "out"))).count() == 2


def test_three_layouts_of_service_graphs(spark, tmp_path):
    import json

    from archspark.sources import ir as IR

    layouts = [
        {"nodes": [{"nodeName": "A", "nodeType": "s"}, {"nodeName": "B"}], "links": [{"source": "A", "target": "B", "requests": []}]},
        {"systemName": "x", "nodes": [{"nodeName": "A", "nodeType": "s", "dependencies": [], "targets": [{"nodeName": "B"}]}, {"nodeName": "B", "dependencies": [{"nodeName": "A"}], "targets": []}]},
        {"nodes": [{"id": "A", "nodeType": "s"}, {"id": "B"}], "links": [{"source": "A", "target": "B", "functions": []}]},
    ]
    for i, layout in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(json.dumps(layout))
        nodes, links = IR.read_graph(spark, str(tmp_path / f"{i}.json"))
        assert {r.id: r.type for r in nodes.collect()} == {"A": "s", "B": None} and [tuple(r) for r in links.collect()] == [("A", "B")]


def test_lookups_and_names(spark):
    from archspark.operators import answers, census, enrich, scenario

    one = lambda c: spark.range(1).select(c).first()[0]
    score = lambda u, t: one(enrich.confidence(F.lit(u), F.lit(t)))
    assert score("/api/users/{id}", "/api/users/{?}") == 100 and score("/api/user/{id}", "/api/users/{?}") == 50 and score("/{a}/{b}", "/{x}/{y}") == 100
    assert score("/api/users/7", "/api/users/{?}") == 0 and score("/api", "/api/users") == 0
    classes = spark.createDataFrame([("s", "services", 0, "OrderService", "JInterface"), ("s", "unknowns", 1, "OrderServiceImpl", "JClass"), ("s", "repositories", 2, "Repo", "JInterface")], "service string, bucket string, pos int, name string, kind string")
    wanted = spark.createDataFrame([("s", "a.b.OrderService"), ("s", "Repo"), ("s", "Gone")], "service string, name string")
    assert {r.wanted: r.name for r in enrich.looked_up(wanted, classes).collect()} == {"a.b.OrderService": "OrderServiceImpl", "Repo": "Repo"}
    rows = spark.createDataFrame([("Orders",), ("users",)], "n string")
    assert [r.n for r in enrich.searched(rows, F.col("n"), ["ORD", ""]).collect()] == ["Orders"] and enrich.searched(rows, F.col("n"), []).count() == 2
    ends = spark.createDataFrame([(1, "a", "C", "m"), (2, "b", "C", "m"), (3, "a", "C", "x")], "id int, service string, controller string, method string")
    names, services = spark.createDataFrame([("a.C.m",), ("b.C.m",)], "name string"), spark.createDataFrame([("a",)], "service string")
    assert [r.scenario for r in enrich.wanted(ends, names, services).collect()] == ["scn_1"] and enrich.wanted(ends, names).count() == 2
    assert one(scenario.higher(F.lit("A"), F.lit("B"), F.array(F.lit("A"), F.lit("B")))) is True and one(scenario.roles_or_default(F.array().cast("array<string>"))) == ["ADMIN", "USER"]
    pick = lambda kind, label, level: one(scenario.template(F.lit(kind), F.lit(label), F.lit(level)))
    assert pick("EntryPointAuthorization", "ENTRYPOINT_POLICY_EXPOSURE_PII_PUBLIC", "LOW") == "entrypoint_public_sensitive" and pick("x", "UNSET", "LOW") == "generic_authorization" and pick("x", "DOWNSTREAM_OVER_PERMISSIVE_PII_PUBLIC", "LOW") == "downstream_inconsistency_simple"
    assert one(answers.known_citations(F.lit("see [E1], [E7] and [E0]"), F.lit(2))) == "see [E1], [citation_removed] and [citation_removed]"
    shown = "query string, place int, id string, kind string, artifact string, version string, location string, entity string, service string, path string, markers string, content string"
    rows = spark.createDataFrame([("q", 2, "2", "IR", *[" "] * 7, "b"), ("q", 1, "1", "GRAPH", "a1", "v", "l", "e", "s", "/p", None, "a")], shown)
    contexts = spark.createDataFrame([("q", True, False, True, "sys", None, "", "/x"), ("none", False, True, False, None, None, None, None)], "query string, truncated boolean, stale boolean, has_context boolean, system string, commit string, service string, endpoint string")
    blocks = {r.query: r.block for r in answers.evidence_block(contexts, rows).collect()}
    record = "- EvidenceRecord {{ id={}; artifactType={}; artifactId={}; artifactVersion={}; locationHint={}; entity={}; service={}; endpoint={}; antiPatterns={}; content={} }}\n".format
    na = ["n/a"] * 7
    assert blocks["q"] == "EvidenceRecords:\nContextSummary: system=sys, commit=n/a, service=n/a, endpoint=/x\nEvidenceState: truncated=true, staleContext=false\nEvidenceCount: 2\nEvidenceList:\n" + record("1", "GRAPH", "a1", "v", "l", "e", "s", "/p", "n/a", "a") + record("2", "IR", *na, "b")
    assert blocks["none"] == "EvidenceRecords:\nEvidenceState: truncated=false, staleContext=true\nEvidenceCount: 0\nEvidenceList: none\n"
    docs = [(1, '{"antiPattern": {"type": "x", "antiPattern": "z"}, "a": [{"antiPattern": "y"}, {"antiPattern": null}, {"antiPatterns": ["y", "w"]}]}'), (2, "no JSON"), (3, '{"antiPatterns": "y", "antiPattern": ""}')]
    assert {(r.id, r.name, r.n) for r in census.anti_patterns(spark.createDataFrame(docs, "id int, data string")).collect()} == {(1, "z", 1), (1, "y", 2), (1, "w", 1)}


def test_more_text_functions(spark):
    import re

    one = lambda c: spark.range(1).select(c).first()[0]
    assert re.fullmatch(X.flexible_name("train-ticket x"), "train_ticketx")
    assert one(X.without_fence(F.lit("```json\n{}\n```"))) == "{}" and one(X.without_fence(F.lit("{}"))) == "{}"
    assert tuple(one(X.github(F.lit("https://github.com/own/re.po.git")))) == ("own", "re.po") and tuple(one(X.github(F.lit("http://x/y")))) == (None, None)
    assert one(X.subject(F.lit("a" * 300 + "\nb"))) == "a" * 200 and one(X.first_hop(F.lit(" 1.2.3.4 , 5.6.7.8"))) == "1.2.3.4"
    assert [one(X.public_address(F.lit(i))) for i in ("8.8.8.8", "10.1.1.1", "172.20.0.1", "192.168.0.1", "127.0.0.1", "300.1.1.1", "x")] == [True] + [False] * 6
    assert one(X.spel_roles(F.lit("hasRole('ADMIN') or hasAnyRole('ROLE_USER', \"X\")"))) == ["ADMIN", "USER", "X"]
    names = {"MoneyXRepository": "Money", "ConsignPriceConfigRepository": "ConsignPrice", "StationFoodRepository": "StationFoodStore", "ConsignRepository": "ConsignRecord", "NotifyRepository": "NotifyInfo", "orderRepository": "order", "OrderOtherRepository": "Order"}
    assert {n: one(X.entity_of_repository(F.lit(n))) for n in names} == names
    assert one(X.entity_of_repository(F.lit("OrderRepository"))) == "Order" and one(X.entity_of_repository(F.lit("Order"))) == "Order"
    assert [one(X.tokens_per_minute(F.lit(n))) for n in (50_000, 2_000_000, 1500)] == ["50K", "2M", "1500"]


def test_structured_retrieval_and_entities(spark):
    from archspark.operators import retrieve

    q = spark.createDataFrame([(1, "What does order-service do?"), (2, "Who calls GET /api/x/{id}?"), (3, "Tell me about the services")], "query int, text string")
    assert {r.query: r.e for r in q.select("query", retrieve.entities(F.col("text")).alias("e")).collect()} == {1: ["order-service"], 2: ["/api/x/{id}", "GET /api/x/{id}"], 3: []}
    e = spark.createDataFrame([("a", "SERVICE", "n", "Order-Service", None, None), ("b", "ENDPOINT", "n", "order-service", "/api/x/{id}", "get"), ("c", "IR", "m", "other", None, None)], "id string, kind string, entity string, service string, path string, method string")
    got = [(r.query, r.id, r.place) for r in retrieve.structured(q, e).orderBy("query", "place").collect()]
    assert got == [(1, "b", 1), (1, "a", 2), (2, "b", 1)]


def test_store_of_versions(spark):
    rows = [(1, "Train Ticket", "1.2.0"), (2, "train-ticket", "1.10.0"), (3, "train_ticket", None), (4, "other", "9.0.0")]
    s = spark.createDataFrame([(*r, "2020", "d", '{"name":"x","version":null}') for r in rows], "id int, name string, version string, created string, description string, payload string")
    assert [r.id for r in store.by_name(s, "TRAIN TICKET").collect()] == [2, 1] and store.by_name(s, "train", 1).count() == 1 and not store.exists(s, "gone")
    assert [r.version for r in store.versions(s, "other").collect()] == ["9.0.0"] and {r.id for r in store.by_ids(s, spark.createDataFrame([(1,), (1,), (7,)], "id int"), "id").collect()} == {1}
    nested = store.with_version(s.withColumn("payload", F.lit('{"version": "1", "a": {"version": 9, "b": [1.5, null]}}')), F.col("id") == 3, "2.0.0", "new").where("id = 3").first()
    assert (nested.description, json.loads(nested.payload)) == ("new", {"version": "2.0.0", "a": {"version": 9, "b": [1.5, None]}})
    assert store.with_version(s.withColumn("payload", F.lit("[1]")), F.lit(True), "2.0.0").first().payload == "[1]"
    set_ = {r.id: (r.version, r.payload) for r in store.with_version(s, F.col("id") == 3, "2.0.1").collect()}
    assert set_[3] == ("2.0.1", '{"name":"x","version":"2.0.1"}') and set_[4][0] == "9.0.0"
    with pytest.raises(ValueError):
        store.with_version(s, F.col("id") == 3, "2.0")
    hit, miss = store.cached(spark.createDataFrame([(1,), (9,)], "id int"), s, "id")
    assert [r.id for r in hit.collect()] == [1] and [r.id for r in miss.collect()] == [9]
