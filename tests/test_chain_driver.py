"""What passes through the driver in call chains and their statistics: no side of a join that grows with the graph."""

import pytest
from conftest import SF
from test_call_chain import plain

from archspark.operators import graph
from archspark.plans import catalogue as bindings

CALLS = [(3, 0, 2), (3, 1, 1), (2, 0, 1), (2, 1, 0), (10, 0, 11), (11, 0, 10), (11, 1, 3)]


@pytest.fixture
def plans(monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    plans, keep = [], graph.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "checkpointed", seen)
    return plans


def chain(spark, roots):
    """Of tables whose size Spark knows, as it does a file's, and finds small."""
    table = lambda rows, names: spark.sql(f"select * from values {', '.join(f'({x})' for x in rows)} as t({names})")
    return graph.call_chain(table((f"{s}, {p}, {d}" for s, p, d in CALLS), "src, pos, dst"), table(roots, "id"))


def sent_whole(plans, *results):
    plans = plans + [df._jdf.queryExecution().executedPlan().toString() for df in results]
    assert [p for p in plans if "SortMergeJoin" in p]
    return [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("roots", [(0, 1, 2, 3), (1, 2, 3), (3,), (0, 1, 2, 3, 10, 11)])  # all, most, one of few, some on a cycle
def test_chains(spark, plans, roots):
    got = chain(spark, roots)
    assert {tuple(x) for x in got.select("root", "node", "position", "depth", "cycles").collect()} == plain(CALLS, roots)
    assert not sent_whole(plans, got)


def test_statistics(spark, plans):
    required = spark.sql("select * from values (0, array('USER')), (1, cast(array() as array<string>)), (11, array('ADMIN')) as t(node, roles)")
    got = graph.chain_statistics(chain(spark, (0, 3, 10)), required)
    assert {tuple(x) for x in got.collect()} == {(0, 1, 1, 0, 0, 0, 1, False), (3, 4, 2, 2, 2, 1, 1, True), (10, 6, 3, 3, 4, 1, 2, True)}
    assert not sent_whole(plans, got)


def test_corpus_statistics_of_a_table(spark, plans):
    got = bindings.QUERIES["g2_corpus_statistics"](spark, SF)
    assert got.count() == 1
    assert not sent_whole(plans, got)
