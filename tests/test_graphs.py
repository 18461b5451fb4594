"""The graph store: a load replaces all or nothing; payloads come back as they were."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from archspark.sources import graphs
from archspark.sources.ir import decoded


def test_a_load_that_fails_leaves_the_graph_before(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    nodes = spark.range(10).select("id")
    links = spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graphs.manifest(spark, folder) is None
    with pytest.raises(ValueError):
        graphs.current(spark, folder)
    first = graphs.replace(nodes, links, folder)
    broken = links.withColumn("dst", F.when(F.col("src") < 8, F.col("dst")).otherwise(F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        graphs.replace(nodes.limit(3), broken, folder)
    with pytest.raises(ValueError, match="no node"):
        graphs.replace(nodes.limit(3), links, folder)
    n, e = graphs.current(spark, folder)
    assert (n.count(), e.count(), graphs.manifest(spark, folder)["rows"]) == (10, 9, {"nodes": 10, "links": 9})
    second = graphs.replace(nodes.where("id < 4"), links.where("dst < 4"), folder)
    held = graphs.manifest(spark, folder)
    assert (held["version"], held["before"], graphs.current(spark, folder)[1].count()) == (second, first, 3)
    assert n.count() == 10  # who was reading the one before still can
    assert {p.name for p in (tmp_path / "g").iterdir() if p.is_dir()} == {first, second}


def test_payloads(spark):
    rows = spark.createDataFrame([(1, "ä", None, [1, 2]), (2, None, 1.5, None)], "id int, name string, x double, l array<int>")
    zipped = rows.select("id", graphs.gzip_payload("name", "x", "l").alias("payload"))
    assert {r.id: json.loads(gzip.decompress(r.payload)) for r in zipped.collect()} == {1: {"name": "ä", "x": None, "l": [1, 2]}, 2: {"name": None, "x": 1.5, "l": None}}
    back = decoded(zipped, "payload", "name string, x double, l array<int>")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
