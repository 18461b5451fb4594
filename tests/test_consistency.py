"""The data consistency rule against a plain loop, and without comparing a pair with all that both touch."""

import random

from conftest import most_rows

from archspark.operators import policy

ENDPOINTS, TOUCHES, LINKS = "name int, mask int", "endpoint int, repo int, ops int", "caller int, callee int"


def plain(masks, touches, links, roles):
    ops = {}
    for e, r, o in touches:
        ops[e, r] = ops.get((e, r), 0) | o
    known = {e: m for e, m in masks.items() if m is not None}
    denied = {(a, role) for a, b in links for role in roles if b in known and known[b] & role == 0}
    found = set()
    for (x, repo), o in ops.items():
        for (y, other), p in ops.items():
            if repo == other and x in known and y in known and o & p == p and all(ops[x, r] & ops[y, r] == ops[y, r] for e, r in ops if e == x and (y, r) in ops):
                found |= {(role, repo, x, y) for role in roles if known[x] & role and not known[y] & role and (y, role) not in denied}
    return found


def test_consistency_equals_a_loop(spark):
    r = random.Random(5)
    masks = {k: r.choice([None, 0, 1, 2, 3, 5, 6, 7]) for k in range(25)}
    touches = [(r.randrange(27), r.randrange(12), r.choice([2, 4, 8])) for _ in range(150)]
    links = [(r.randrange(27), r.randrange(27)) for _ in range(15)]
    roles = [1, 2, 4, 6]
    got = policy.inconsistent_touches(spark.createDataFrame(list(masks.items()), ENDPOINTS), spark.createDataFrame(touches, TOUCHES), spark.createDataFrame(links, LINKS), roles)
    want = plain(masks, touches, links, roles)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_a_pair_is_not_compared_on_all_that_both_touch(spark):
    n = 400
    touches = [(e, k, 6 if e == 1 else 2) for k in range(n) for e in (1, 2)] + [(e, k, 4 if e == 3 and k == n else 2) for k in range(n, 2 * n) for e in (3, 4)]
    masks = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 2)], ENDPOINTS)
    got = policy.inconsistent_touches(masks, spark.createDataFrame(touches, TOUCHES), spark.createDataFrame([], LINKS), [1, 2])
    assert {tuple(x) for x in got.where("role = 1").collect()} == {(1, k, 1, 2) for k in range(n)}
    assert most_rows(got) <= 8 * n  # n * n before
