"""A graph's nodes and links as a store that is replaced as a whole, and results as gzip payloads.

A load writes its tables to a folder of its own and then names that folder in the manifest, by one rename. Until then readers
see the graph before, and a load that fails, or whose driver is lost, leaves nothing but a folder that the next load removes.
Tasks that run again are the write committer's business.
"""

from __future__ import annotations

import gzip
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "current.json"
TABLES = ("nodes", "links")


def _files(spark: SparkSession, folder: str):
    """Hadoop's file context and path class for a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.FileContext.getFileContext(hadoop.Path(folder).toUri(), spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Write the manifest beside its place and move it there at once."""
    hadoop, files = _files(spark, folder)
    beside, place = hadoop.Path(f"{folder}/.{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/{MANIFEST}")
    out = hadoop.FileSystem.get(beside.toUri(), spark._jsc.hadoopConfiguration()).create(beside)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(beside, place, over)


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the folder's current graph is: version, the one before, and rows by table; None before the first load."""
    hadoop, files = _files(spark, folder)
    place = hadoop.Path(f"{folder}/{MANIFEST}")
    if not files.util().exists(place):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))


def replace(nodes: DataFrame, links: DataFrame, folder: str) -> str:
    """Replace the folder's graph by nodes and links; links with an end that is no node are an error, and then the graph before stays. Returns the new version.

    The version before is kept for those who are reading it; older ones, and what failed loads left, are removed.
    """
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    before = manifest(spark, folder)
    nodes.write.parquet(f"{folder}/{version}/nodes")
    links.write.parquet(f"{folder}/{version}/links")
    own = {t: spark.read.parquet(f"{folder}/{version}/{t}") for t in TABLES}
    ends = own["links"].select(F.explode(F.array("src", "dst")).alias("id"))
    loose = ends.join(own["nodes"].select("id"), "id", "left_anti").first()
    if loose:
        raise ValueError(f"a link's end is no node: {loose['id']}")
    _put(spark, folder, {"version": version, "before": before and before["version"], "rows": {t: df.count() for t, df in own.items()}})
    hadoop, files = _files(spark, folder)
    found = files.util().listStatus(hadoop.Path(folder))
    for path in [f.getPath() for f in found if f.isDirectory()]:
        if path.getName() not in (version, before and before["version"]):
            files.delete(path, True)
    return version


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and links of the folder's graph."""
    held = manifest(spark, folder)
    if held is None:
        raise ValueError(f"no graph in {folder}")
    return tuple(spark.read.parquet(f"{folder}/{held['version']}/{t}") for t in TABLES)


def gzip_payload(*columns: Column | str) -> Column:
    """The columns as one JSON object, gzip-compressed; equal rows give equal bytes. `ir.decoded` reads it."""

    @F.arrow_udf("binary")
    def zipped(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else gzip.compress(v.encode(), mtime=0) for v in values.to_pylist()], pa.binary())

    return zipped(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
