"""Every bound query that SQL can express equals DuckDB's result; the others equal a plain version."""

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from archspark.plans import catalogue as bindings


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_equals_sql(spark, duck, name):
    same(bindings.QUERIES[name](spark, SF), duck.sql(bindings.ORACLES[name]))


def test_budget_keeps_the_direct_match_and_skips_what_is_too_long(spark):
    from archspark.operators.retrieve import budgeted, omitted

    rows = [(1, 0, "a", "IR", 99_999, False, False), (1, 1, "b", "IR", 5, False, False), (2, 0, "a", "IR", 5, False, False), (2, 1, "b", "GRAPH", 500, True, True), (3, 0, "a", "IR", 60, True, False), (3, 1, "b", "X", 60, False, False), (3, 2, "c", "IR", 40, False, False)]
    df = spark.createDataFrame([(*r, "DEPENDENCY", "") for r in rows], "query int, place int, id string, kind string, n_chars int, inferred boolean, direct boolean, intent string, location string")
    got = budgeted(df, 20, 100)
    assert {r.query: r.ids for r in got.where("kept").groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()} == {1: ["b"], 2: ["b"], 3: ["b", "c"]}
    assert {(r.query, r.kind, r.n) for r in omitted(got).collect()} == {(1, "IR", 1), (2, "IR", 1), (3, "IR", 1)}
    assert budgeted(df, 0, 100).where("kept").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
