"""Call chains against a plain depth-first search, and without writing what is known again in each round."""

import random

from archspark.operators import graph


def plain(calls, roots):
    out = set()
    for root in roots:
        seen, twice = [], []

        def visit(node, depth):
            seen.append(node)
            out.add((root, node, len(seen) - 1, depth))
            for _, dst in sorted({(p, d) for s, p, d in calls if s == node and d is not None}):
                if dst in seen:
                    twice.append(dst)
                else:
                    visit(dst, depth + 1)

        visit(root, 0)
        out = {(*r, bool(twice)) if r[0] == root and len(r) == 4 else r for r in out}
    return out


def test_chains_equal_a_search(spark):
    r = random.Random(3)
    dag = [(k, p, r.randrange(k)) for k in range(1, 12) for p in range(r.randint(0, 3))] + [(5, 9, None)]
    loops = dag + [(20, 0, 21), (21, 0, 3), (21, 1, 20), (21, 2, 22), (23, 0, 21), (24, 0, 24), (24, 1, 2)]
    for calls, roots in ((dag, range(14)), (loops, range(26)), (dag, [11])):
        got = graph.call_chain(spark.createDataFrame(calls, "src int, pos int, dst int"), spark.createDataFrame([(k,) for k in roots], "id int"))
        assert {tuple(x) for x in got.select("root", "node", "position", "depth", "cycles").collect()} == plain(calls, roots)


def test_chains_are_written_once(spark, monkeypatch):
    written, keep = [], graph.checkpointed

    def counted(df):
        kept = keep(df)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "checkpointed", counted)
    n = 14
    calls = spark.createDataFrame([(k, 0, k - 1) for k in range(1, n)], "src int, pos int, dst int")
    rows = graph.call_chain(calls, spark.range(n)).count()
    assert rows == n * (n + 1) // 2
    assert sum(written) <= 4 * rows  # n rounds of all rows before
