"""What passes through the driver in a search over components: no side of a join that grows with the graph."""

from archspark.operators import graph


def test_large_sides_are_not_sent_to_all(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    plans, keep = [], graph.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "checkpointed", seen)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(k, 1 << k) for k in range(5)], "id long, bits long")
    got = graph.accumulated(nodes, edges)
    assert {tuple(x) for x in got.collect()} == {(0, 31), (1, 31), (2, 31), (3, 24), (4, 16)}
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Join" in p and "Broadcast" in p]
