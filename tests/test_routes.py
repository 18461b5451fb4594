"""URL templates and remote calls against a plain loop over all templates."""

import random
import re

from pyspark.sql import functions as F

from archspark.operators import routes


def test_services_of_paths(spark):
    want = {"/api/v1/orderservice/x": "ts-order-service", "/api/v1/orderOtherService/x": "ts-orderother-service", "/api/v1/order_other_service/x": "ts-order-other-service", "/x/my__Servicex/y": "ts-my-x-service", "/service/a": None, "/a/b": None}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.s for r in df.select("p", routes.service_of_path(F.col("p")).alias("s")).collect()} == want


def normal(url):
    return re.sub("^/+|/+$", "", re.sub(r"\?.*$", "", re.sub("^https?://[^/]+", "", url)))


def parts(url):
    p = normal(url)
    return p.split("/") if p else []


def is_variable(s):
    return re.fullmatch(r"\{.*\}", s) is not None


def fits(url, template):
    u, t = parts(url), parts(template)
    return len(u) == len(t) and all(re.fullmatch("[A-Za-z0-9._-]{1,200}", a) if is_variable(b) else a.lower() == b.lower() for a, b in zip(u, t))


def score(url, template):
    u, t = parts(url), parts(template)
    if len(u) != len(t) or any(is_variable(a) != is_variable(b) for a, b in zip(u, t)):
        return 0
    fixed = [(a, b) for a, b in zip(u, t) if not is_variable(b)]
    return 100 * sum(a.lower() == b.lower() for a, b in fixed) // len(fixed) if fixed else 100


def name(service):
    return re.sub("^(ts|ms|svc)", "", re.sub("[-_]", "", service.lower()))


def plain(call, templates):
    i, service, method, url = call
    mine = [t for t in templates if method and t[2].upper() == method.upper()]

    def resolve(s):
        own = [t for t in mine if name(t[1]) == name(s)]
        hit = [t for t in own if fits(url, t[3])]
        if hit:
            return min(hit, key=lambda t: (-sum(not is_variable(x) for x in parts(t[3])), t[0]))
        close = [t for t in own if score(url, t[3]) >= 90]
        return min(close, key=lambda t: (-score(url, t[3]), t[0])) if close else None

    first = resolve(service) if service else None
    if first:
        return i, service, first[4], first[3], "own"
    hit = [t for t in mine if fits(url, t[3])]
    close = [t for t in mine if score(url, t[3]) >= 80]
    found = min(hit, key=lambda t: t[0])[1] if hit else min(close, key=lambda t: (-score(url, t[3]), t[0]))[1] if close else None
    again = resolve(found) if found else None
    if again:
        return i, found, again[4], again[3], "retry" if service else "index"
    return i, service or found, None, None, None


def test_resolved_calls_equal_a_loop(spark):
    r = random.Random(7)
    segment = lambda: r.choice(["a", "b", "C", "{x}", "k1", "k2"])
    services = ["ts-a", "svc_B", "c"]
    templates = [(k, r.choice(services), r.choice(["get", "POST"]), r.choice(["/", ""]) + "/".join(segment() for _ in range(r.randint(0, 6))), f"e{k}") for k in range(150)]
    long = "/".join(f"s{k}" for k in range(12))
    templates += [(900, "c", "GET", f"/{long}/{{id}}", "long"), (901, "c", "GET", "/only/{id}", "one")]
    urls = ["http://h:1/" + "/".join(r.choice(["A", "b", "c", "{y}", "k1", "zz", "bad seg", ""]) for _ in range(r.randint(0, 6))) + r.choice(["", "/", "?q=/a"]) for _ in range(200)]
    urls += [f"/{long.replace('s3', 'x')}/{{other}}", f"/{long}/7", "/only/7", "/only/{v}", "/"]
    calls = [(k, r.choice([None, "TS_A", "b", "nowhere"]), r.choice([None, "GET", "post", "GET"]), u) for k, u in enumerate(urls)]
    got = routes.resolved_calls(spark.createDataFrame(calls, "id int, service string, method string, url string"), spark.createDataFrame(templates, "pos int, service string, method string, template string, endpoint string"))
    want = [plain(c, templates) for c in calls]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[4] for w in want} == {"own", "index", "retry", None}
