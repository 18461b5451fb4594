"""Details of an IR: hand-computed cases and a plain depth-first search."""

import json
import random

from pyspark.sql import functions as F

from archspark.operators import answers, features, graph
from archspark.sources import ir as IR


def test_features_of_odd_nodes(spark):
    rows = [(1, '{"customerEmail": "x", "isActive": true, "maxPrice": 3}'), (2, "[1]"), (3, None), (4, "{"), (5, "{}"), (6, '{"a": "true", "systemName": 1, "annotations": null}')]
    got = {r.id: (r.has_pii, r.evidence, r.hints) for r in features.ir_features(spark.createDataFrame(rows, "id int, doc string")).collect()}
    assert got[1] == (True, ["field: customerEmail"], ["isActive must be True to pass validation", "maxPrice > 0 required"])
    assert all(got[i] == (False, [], []) for i in (2, 3, 4, 5, 6))


def test_small_json(spark):
    deep = "1"
    for _ in range(12):
        deep = '{"a": %s}' % deep
    doc = {"x": 1, "id": 7, "methods": [{"name": "m", "url": "/u", "httpMethod": "GET"}, {"name": "n"}, 3], "logs": [1, 2, 3, 4], "timelineIRs": [1, 2], "test_code": "c" * 200, "text": "t" * 600, "a": {"b": {"c": {"id": 1, "d": None}}}}
    got = [r.doc for r in features.minified(spark.createDataFrame([(1, json.dumps(doc)), (2, deep), (3, "no"), (4, None), (5, "[" * 100_000)], "id int, doc string")).orderBy("id").collect()]
    assert json.loads(got[0]) == {"id": 7, "methods": ["m [GET /u]", "n"], "logs": [2, 3, 4], "timelineIRs": "[2 Timeline snapshots omitted for size]", "test_code": "c" * 150 + "... [CODE TRUNCATED]", "text": "t" * 500 + "... [TRUNCATED - Original length: 600]", "a": {"b": {"c": {"d": None}}}}
    assert got[1].count('"a"') == 10 and "[Max Depth Reached]" in got[1] and got[2:] == [None, None, None]


def test_local_descent_against_a_depth_first_search(spark):
    random.seed(3)
    local = sorted({(random.randrange(8), 2 * random.randrange(4), random.randrange(8)) for _ in range(14)})
    local = [e for i, e in enumerate(local) if i == 0 or e[:2] != local[i - 1][:2]]
    remote = [(m, 2 * k + 1, f"t{m}{k}") for m in range(8) for k in range(3) if random.random() < 0.5]

    def walk(m, seen, depth, out):
        for pos, kind, what in sorted([(p, 0, d) for s, p, d in local if s == m] + [(p, 1, t) for s, p, t in remote if s == m]):
            if kind:
                out.append((m, pos, depth, what))
            elif what not in seen:
                seen[what] = depth + 1
                walk(what, seen, depth + 1, out)
        return out

    rows, counts = graph.local_descent(spark.createDataFrame(local, "src int, pos int, dst int"), spark.createDataFrame(remote, "method int, pos int, target string"), spark.range(8).selectExpr("cast(id as int) as id"))
    got = {}
    for r in rows.orderBy("root", "place").collect():
        got.setdefault(r.root, []).append((int(r.method), r.pos, r.depth, r.target))
    n = {r.root: (r.n_remote, r.local_methods, r.max_local_depth, r.nested) for r in counts.collect()}
    for m in range(8):
        seen = {}
        want = walk(m, seen, 0, [])
        assert got.get(m, []) == want
        assert n[m] == (len(want), len(seen), max(seen.values(), default=0), sum(d for _, _, d, _ in want))


def test_guardrails(spark):
    asked = "id int, question string, intent string, kinds array<string>, origins array<string>, missing array<string>, no_context boolean"
    rows = [(1, "hi", "GENERAL", [], [], [], False), (2, "which commit?", None, ["TEST"], ["direct"], [], True), (3, "q", "DEPENDENCY", ["GRAPH"], ["inferred"], None, None), (4, None, "ENDPOINT_LOOKUP", None, None, ["GIT"], None)]
    df = spark.createDataFrame(rows, asked)
    got = {r.id: (r.flag, r.blocked, r.missing_sources) for r in answers.before_generation(df).collect()}
    assert got == {1: (None, False, []), 2: ("PARTIAL", False, ["active context"]), 3: ("PARTIAL", False, ["dependency"]), 4: ("INSUFFICIENT_EVIDENCE", True, ["git", "IR", "endpoint data"])}
    assert {r.id: r.blocked for r in answers.before_generation(df, strict=True).collect()} == {1: False, 2: True, 3: True, 4: True}
    done = spark.createDataFrame([(1, "q", "DEPENDENCY", "[Example] [E1]", ["a"], ["a"], ["GRAPH"], ["direct"]), (2, "hi", "GENERAL", "[E9]", ["z"], [], [], []), (3, "q", "DEPENDENCY", None, None, [], [], [])], "id int, question string, intent string, answer string, citations array<string>, artifacts array<string>, kinds array<string>, origins array<string>")
    got = {r.id: (r.answer, r.flags, r.confidence) for r in answers.after_generation(done).collect()}
    assert got == {1: ("[citation_removed] [E1]", ["CITATION_VALIDATION_FAILED"], "LOW"), 2: ("[E9]", [], None), 3: (None, [], None)}


def test_structure_and_component_links(spark, tmp_path):
    call = lambda name, kind: {"name": name, "objectType": kind, "calledFrom": "f", "parameterContents": "x"}
    service = {"name": "a", "controllers": [{"name": "C", "methods": [{"id": "1", "name": "f"}], "imports": [{"name": "p.entity.E", "importObject": "E"}, {"name": "p.other", "importObject": "O"}], "methodCalls": [call("g", "S"), call("h", "S"), call("f", "C"), call("f", "Gone")]}],
               "services": [{"name": "SImpl", "implementedTypes": ["S"], "methods": [{"id": "2", "name": "g", "returnType": "int"}]}]}
    (tmp_path / "a.json").write_text(json.dumps({"name": "sys", "microservices": [service, {"name": "b"}]}))
    ir = IR.read_ir(spark, str(tmp_path / "a.json"))
    links = IR.component_links(ir, spark.createDataFrame([("a",), ("b",)], "service string"))
    assert sorted((r.src, r.dst, r.function, r.returns) for r in links.collect()) == [("C", "S", "g", "int"), ("C", "S", "h", "void")]
    assert sorted((r.src, r.dst, r.kind) for r in IR.structural_edges(ir).collect()) == [("a", "a.C", "hierarchy"), ("a", "a.SImpl", "hierarchy"), ("a.C", "E", "uses"), ("a.C", "a.C.f", "hierarchy"), ("a.SImpl", "a.SImpl.g", "hierarchy")]
    assert [(r.entity, r.service, r.n) for r in IR.entity_dependents(ir).collect()] == [("E", "a", 1)]


def test_statuses_without_a_type(spark):
    one = lambda *c: spark.range(1).select(features.statuses(*c)).first()[0]
    no = F.lit(None)
    assert one(no.cast("string"), no.cast("boolean"), no.cast("boolean"), no.cast("array<string>")) == {} and one(F.lit("String"), F.lit(False), F.lit(False), no.cast("array<string>")) == {"200": "String"}
