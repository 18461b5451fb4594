"""Containment by n-grams against all pairs, and role rules against a plain loop over the files."""

import random

import pytest
from conftest import most_rows
from pyspark.sql import functions as F

from archspark.operators import containment


def test_holding_equals_all_pairs(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choices("abÄ-", k=n))
    texts = [(k % 3, k, word(r.randint(0, 14)) if k % 17 else None) for k in range(200)]
    needles = [(k % 3, word(r.randint(0, 7))) for k in range(120)]
    t, n = spark.createDataFrame(texts, "g int, id int, text string"), spark.createDataFrame(needles, "g int, needle string")
    want = {(g, i, x) for g, i, t_ in texts for h, x in needles if g == h and x and t_ is not None and x in t_}
    assert {tuple(x) for x in containment.holding(t, n, ["g"]).collect()} == want and len(want) > 300
    assert {tuple(x) for x in containment.holding(t.drop("g"), n).collect()} == {(i, x) for _, i, t_ in texts for _, x in needles if x and t_ is not None and x in t_}
    assert containment.holding(t, n.where("needle = ''"), ["g"]).count() == 0


def test_components_and_inferred_edges(spark):
    s = spark.createDataFrame([("order",), ("pay",), ("none",)], "service string")
    c = spark.createDataFrame([(3, "c3", "OrderService", "order-ms"), (1, "x-pay", "A", None), (2, "pay2", "pay", "pay")], "pos int, id string, name string, microservice string")
    assert {tuple(x) for x in containment.component_of(s, c).collect()} == {("order", 3, "c3"), ("pay", 1, "x-pay"), ("none", None, None)}
    nodes = spark.createDataFrame([(1, "a"), (1, "bb"), (2, "cc")], "snapshot int, name string")
    calls = spark.createDataFrame([(1, "a", "GET http://bb/x"), (1, "bb", "bb local a"), (1, "a", "cc"), (2, "cc", "bb")], "snapshot int, src string, signature string")
    assert {tuple(x) for x in containment.inferred_edges(nodes, calls).collect()} == {(1, "a", "bb"), (1, "bb", "a")}


def plain_masks(endpoints, rules, files, initial):
    roles, masks, names = dict(initial), {p: 0 for _, p, _, _ in endpoints}, [(s, p, f"{m} {u}") for s, p, m, u in endpoints]
    done: set = set()

    def bit(name):
        for b, n in roles.items():
            if n == name:
                return b
        b = next(1 << k for k in range(63) if 1 << k not in roles)
        roles[b] = name
        return b

    for service, file, authenticated in sorted(files, key=lambda f: f[1]):
        for _, _, _, kind, method, patterns, given in sorted((r for r in rules if r[1] == file), key=lambda r: r[2]):
            if kind == "hasRole":
                for g in given:
                    bit(g)
            for pattern in patterns:
                text = pattern.replace("*", "").rstrip("/") if pattern.endswith("**") else pattern.replace("*", "{?}")
                if method and not pattern.endswith("**"):
                    hit = [p for _, p, n in names if n == f"{method} {text}"][:1]
                else:
                    anyone = kind == "hasRole" and method
                    hit = [p for s, p, n in names if (anyone or s == service) and (f"{method} {text}" if method else text) in n]
                for p in hit:
                    if p not in done:
                        done.add(p)
                        masks[p] = sum(roles) if kind == "permitAll" else sum({bit(g) for g in given})
        for s, p, _ in names:
            if s == service and p not in done:
                done.add(p)
                masks[p] = sum(b for b, n in roles.items() if not (authenticated and n == containment.UNAUTHENTICATED))
    return {(s, p, masks[p]) for s, p, _ in names}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_role_masks_equal_a_loop(spark, seed):
    r = random.Random(seed)
    path = lambda: "/" + "/".join(r.choices(["a", "b", "{?}", "api"], k=r.randint(1, 3)))
    endpoints = [(f"s{k % 5}", k, r.choice(["GET", "POST"]), path()) for k in range(60)]
    files = [(f"s{k}", 10 * k, k % 2 == 0) for k in range(4)]
    rules = []
    for service, file, _ in files:
        for pos in range(8):
            kind = r.choice(["hasRole", "hasAnyRole", "permitAll"])
            given = [] if kind == "permitAll" else r.sample(["u", "v", "w", "x", "user"], 1 if kind == "hasRole" else 2)
            patterns = [p.replace("{?}", "*") + r.choice(["", "/**"]) for p in (path() for _ in range(r.randint(1, 2)))]
            rules.append((service, file, pos, kind, r.choice([None, "GET", "POST"]), patterns, given))
    initial = {1: containment.UNAUTHENTICATED, 2: "user", 8: "admin"}
    got = containment.role_masks(spark.createDataFrame(endpoints, "service string, pos int, method string, url string"), spark.createDataFrame(rules, "service string, file int, pos int, kind string, method string, patterns array<string>, roles array<string>"), spark.createDataFrame(files, "service string, file int, authenticated boolean"), initial)
    assert {tuple(x) for x in got.collect()} == plain_masks(endpoints, rules, files, initial)


def test_rules_of_one_pattern_do_not_multiply_endpoints(spark):
    n, m = 400, 300
    endpoints = spark.range(n).select(F.lit("s").alias("service"), F.col("id").cast("int").alias("pos"), F.lit("GET").alias("method"), F.concat(F.lit("/a/"), F.col("id") % 5).alias("url"))
    rules = spark.range(m).select(F.lit("s").alias("service"), F.lit(0).alias("file"), F.col("id").cast("int").alias("pos"), F.lit("hasAnyRole").alias("kind"), F.lit(None).cast("string").alias("method"), F.array(F.lit("/a/**")).alias("patterns"), F.array(F.lit("u")).alias("roles"))
    got = containment.role_masks(endpoints, rules, spark.createDataFrame([("s", 0, False)], "service string, file int, authenticated boolean"), {1: "user"})
    assert got.where("mask = 2").count() == n
    assert most_rows(got) <= 4 * (n + m)  # each endpoint met each rule before
