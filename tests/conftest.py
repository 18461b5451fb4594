import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp / "warehouse")).config("spark.checkpoint.dir", f"file://{tmp}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(spark_df, duck_rel):
    """Both results as sorted rows of text, columns by name, floats at 9 digits."""
    names = sorted(spark_df.columns)
    assert names == sorted(duck_rel.columns)
    text = lambda v: "None" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    a = sorted([tuple(text(r[n]) for n in names) for r in spark_df.collect()])
    at = [duck_rel.columns.index(n) for n in names]
    b = sorted([tuple(text(r[i]) for i in at) for r in duck_rel.fetchall()])
    assert a == b


def most_rows(df):
    """The most rows that one operator of the query's plan gives, by the plan's own count."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        counted = plan.metrics().get("numOutputRows")
        most = max(most, counted.get().value() if counted.isDefined() else 0)
        kind = plan.getClass().getSimpleName()
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return most
