"""Architecture IR: nested JSON documents read with an explicit schema and flattened to tables. Rows without a name or id are left out."""

from __future__ import annotations

import base64
import gzip
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions.text import clean_url

_ANNOTATION = "struct<name: string, attributes: map<string, string>>"
_CALL = "struct<id: string, name: string, objectName: string, objectType: string, calledFrom: string, type: string, url: string, httpMethod: string, parameterContents: string>"
_METHOD = f"struct<id: string, name: string, httpMethod: string, url: string, protection: string, returnType: string, className: string, annotations: array<{_ANNOTATION}>, methodCalls: array<{_CALL}>>"
_CLASS = f"struct<id: string, name: string, type: string, classRole: string, packageName: string, path: string, implementedTypes: array<string>, imports: array<struct<name: string, importObject: string>>, annotations: array<{_ANNOTATION}>, methods: array<{_METHOD}>, methodCalls: array<{_CALL}>>"
_SERVICE = f"struct<name: string, path: string, antiPattern: string, controllers: array<{_CLASS}>, services: array<{_CLASS}>, repositories: array<{_CLASS}>, entities: array<{_CLASS}>, files: array<struct<id: string, name: string, type: string, path: string, data: string>>>"
IR = f"name string, commitID string, version string, microservices array<{_SERVICE}>"
#: Arrays of classes, by role.
ROLES = {"controllers": "Controller", "services": "Service", "repositories": "Repository", "entities": "Entity"}


def read_ir(spark: SparkSession, path: str) -> DataFrame:
    """One system per file (.json or .json.gz); unknown properties are ignored, and missing, empty and null arrays stay apart."""
    return spark.read.schema(IR).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A result as gzip-compressed JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def _plain(blob: bytes | None) -> str | None:
    try:
        if blob[:1] == b"{":
            inner = json.loads(blob)
            if "$binary" not in inner:
                return blob.decode()
            inner = inner["$binary"]
            blob = (inner["base64"] if isinstance(inner, dict) else inner).encode()
        if blob[:2] != b"\x1f\x8b":
            blob = base64.b64decode(blob, validate=True)
        return gzip.decompress(blob).decode()
    except (TypeError, ValueError, KeyError, OSError, EOFError, zlib.error):
        return None


def decoded(blobs: DataFrame, column: str = "payload", schema: str = IR) -> DataFrame:
    """Payloads (gzip bytes, their base64, an object with `$binary`, or JSON itself) as columns of the schema; all null where a payload is none of them."""

    @F.arrow_udf("string")
    def plain_json(values: pa.Array) -> pa.Array:
        return pa.array([_plain(b) for b in values.cast(pa.binary()).to_pylist()], pa.string())

    return blobs.withColumn("_ir", F.from_json(plain_json(F.col(column).cast("binary")), schema)).select(*(c for c in blobs.columns if c != column), "_ir.*")


def services(ir: DataFrame) -> DataFrame:
    """system, pos, service, path, anti_pattern and the nested arrays of each microservice."""
    each = ir.select(F.col("name").alias("system"), "commitID", F.posexplode("microservices").alias("pos", "s")).where("s.name is not null")
    return each.select("system", "commitID", "pos", F.col("s.name").alias("service"), F.col("s.path").alias("path"), F.col("s.antiPattern").alias("anti_pattern"), "s")


def classes(ir: DataFrame) -> DataFrame:
    """system, service, role, class_id, class, path, imports, pos and the methods of each class, of all roles in one pass."""

    def tagged(column: str, role: str) -> Column:
        return F.transform(F.coalesce(F.col(f"s.{column}"), F.array()), lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), x.alias("c")))

    each = services(ir).select("system", "service", F.explode(F.concat(*(tagged(c, role) for c, role in ROLES.items()))).alias("x")).where("x.c.name is not null")
    return each.select("system", "service", "x.role", "x.pos", F.col("x.c.id").alias("class_id"), F.col("x.c.name").alias("class"), F.col("x.c.path").alias("path"), F.col("x.c.imports").alias("imports"), F.col("x.c.methods").alias("methods"))


def methods(ir: DataFrame) -> DataFrame:
    """system, service, role, class, pos, method_id, method, http_method, url (cleaned), protection, annotations, calls."""
    each = classes(ir).select("system", "service", "role", "class", F.posexplode("methods").alias("pos", "m")).where("m.name is not null and m.id is not null")
    url = F.when(F.col("m.url").isNotNull(), clean_url(F.col("m.url")))
    return each.select("system", "service", "role", "class", "pos", F.col("m.id").alias("method_id"), F.col("m.name").alias("method"), F.col("m.httpMethod").alias("http_method"), url.alias("url"), F.col("m.protection").alias("protection"), F.col("m.annotations").alias("annotations"), F.col("m.methodCalls").alias("calls"))


def calls(ir: DataFrame) -> DataFrame:
    """system, service, role, class, method_id, pos, name, object_type, kind, url, http_method: the calls of each method in their order."""
    each = methods(ir).select("system", "service", "role", "class", "method_id", F.posexplode("calls").alias("pos", "c"))
    return each.select("system", "service", "role", "class", "method_id", "pos", F.col("c.name").alias("name"), F.coalesce("c.objectType", F.lit("")).alias("object_type"), F.col("c.type").alias("kind"), F.col("c.url").alias("url"), F.col("c.httpMethod").alias("http_method"))


def annotations(ir: DataFrame) -> DataFrame:
    """system, method_id, name: annotations of methods, each once."""
    return methods(ir).select("system", "method_id", F.explode("annotations").alias("a")).select("system", "method_id", F.col("a.name").alias("name")).where("name is not null").distinct()


def call_links(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee) inside a service: a controller calls methods of `...service` classes by type and name, a service those of `...repository` classes, or of its own class where the call names no type."""
    kind = F.lower("object_type")
    own = calls.where((F.col("role") == "Service") & (F.col("object_type") == "")).withColumn("target", F.col("class"))
    other = calls.where(((F.col("role") == "Controller") & kind.endswith("service")) | ((F.col("role") == "Service") & kind.endswith("repository"))).withColumn("target", F.col("object_type"))
    to = methods.select("system", "service", F.col("class").alias("target"), F.col("method").alias("name"), F.col("method_id").alias("callee"))
    return own.union(other).join(to, ["system", "service", "target", "name"]).select(F.col("method_id").alias("caller"), "callee").distinct()


def view_names(ir: DataFrame) -> DataFrame:
    """system, method_id, unique: names of a graph view, `service.controller.method_k` for controllers and `service.class.method._k` for services."""
    m = methods(ir).where("role in ('Controller', 'Service')")
    k = F.col("pos").cast("string")
    controller = F.concat(F.concat_ws(".", "service", "class", "method"), F.lit("_"), k)
    service = F.concat(F.concat_ws(".", "service", "class", "method"), F.lit("._"), k)
    return m.select("system", "method_id", F.when(F.col("role") == "Controller", controller).otherwise(service).alias("unique"))


def structural_edges(ir: DataFrame) -> DataFrame:
    """(system, src, dst, kind): hierarchy from services to their controllers and service classes and from these to their methods, and uses from classes to the entities they import (packages with `.entity.`), each once. Entities go by their name alone; every controller against every service class of a service, which says nothing of calls, is left out."""
    held = classes(ir).where("role in ('Controller', 'Service')").withColumn("node", F.concat_ws(".", "service", "class"))
    of_service = held.select("system", F.col("service").alias("src"), F.col("node").alias("dst"), F.lit("hierarchy").alias("kind"))
    of_class = held.select("system", "node", F.explode("methods").alias("m")).where("m.name is not null").select("system", "node", F.concat_ws(".", "node", "m.name"), F.lit("hierarchy"))
    uses = held.select("system", "node", F.explode("imports").alias("i")).where(F.contains("i.name", F.lit(".entity.")) & F.col("i.importObject").isNotNull()).select("system", "node", "i.importObject", F.lit("uses"))
    return of_service.union(of_class).union(uses).distinct()


def component_links(ir: DataFrame, selected: DataFrame) -> DataFrame:
    """Calls between the classes of selected(service): system, src, dst, service, pos, source_method, function, argument, returns.

    A class goes by the first type that it implements, else by its name; a controller or service class is linked where a
    call of its own (of the class, not of a method) names the type of another known class. The return type is that of the
    last method of the name in the last class so called, `void` where it has none.
    """

    def ranked(column: str, rank: int) -> Column:
        return F.transform(F.coalesce(F.col(f"s.{column}"), F.array()), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), x.alias("c")))

    arrays = F.concat(*(ranked(c, rank) for rank, c in enumerate(("services", "controllers", "entities", "repositories"))))
    each = services(ir).join(selected.select("service").distinct(), "service", "left_semi").select("system", "service", "pos", F.explode(arrays).alias("x"))
    rows = each.select("system", "service", "pos", "x.rank", "x.at", F.coalesce(F.try_element_at("x.c.implementedTypes", F.lit(1)), "x.c.name").alias("node"), F.col("x.c.methods").alias("methods"), F.col("x.c.methodCalls").alias("calls")).where("node is not null")
    last = rows.groupBy("system", "node").agg(F.max_by("methods", F.struct("pos", "rank", "at")).alias("methods")).withColumnRenamed("node", "dst")
    made = rows.where("rank < 2").select("system", "service", F.col("node").alias("src"), F.col("rank"), "at", F.posexplode("calls").alias("pos", "k")).select("system", "service", "src", "rank", "at", "pos", F.col("k.objectType").alias("dst"), F.col("k.name").alias("function"), F.col("k.calledFrom").alias("source_method"), F.col("k.parameterContents").alias("argument"))
    named = F.filter("methods", lambda m: m["name"] == F.col("function"))
    met = made.where("dst != src").join(last, ["system", "dst"])
    return met.select("system", "src", "dst", "service", "pos", "source_method", "function", "argument", F.coalesce(F.try_element_at(named, F.lit(-1))["returnType"], F.lit("void")).alias("returns"))


def entity_dependents(ir: DataFrame) -> DataFrame:
    """(system, entity, service, n): classes of each service that use an entity."""
    uses = structural_edges(ir).where("kind = 'uses'")
    owner = classes(ir).where("role in ('Controller', 'Service')").select("system", F.concat_ws(".", "service", "class").alias("src"), "service").distinct()
    return uses.join(owner, ["system", "src"]).groupBy("system", F.col("dst").alias("entity"), "service").agg(F.count("*").alias("n"))


def _known(c: str) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def evidence_rows(ir: DataFrame, version: str, max_items: int = 400, endpoints: bool = True) -> DataFrame:
    """Evidence of a system: a row per service with the counts of its controllers and endpoints, then a row per endpoint (a controller's method with HTTP method and URL), in document order; the first max_items of a system."""
    given = lambda m: (F.coalesce(F.trim(m["httpMethod"]), F.lit("")) != "") & (F.coalesce(F.trim(m["url"]), F.lit("")) != "")
    s = services(ir).where("trim(service) != ''").select("system", "pos", "service", "path", F.coalesce("s.controllers", F.array()).alias("controllers"))
    found = F.aggregate("controllers", F.lit(0), lambda n, c: n + F.size(F.filter(F.coalesce(c["methods"], F.array()), given)))
    path = F.coalesce(_known("path"), F.lit("N/A"))
    text = F.format_string("Microservice '%s' (system=%s) is defined in the IR at path %s with %d controller(s) exposing %d HTTP endpoint(s).", "service", F.coalesce(_known("system"), F.lit("N/A")), path, F.size("controllers"), found)
    no = F.lit(None).cast("string")
    of_service = s.select("system", "pos", F.lit(-1).alias("c"), F.lit(-1).alias("m"), "service", F.lit("MICROSERVICE").alias("entity_type"), F.col("service").alias("entity"), no.alias("http_method"), no.alias("url"), text.alias("content"))
    each = s.select("system", "pos", "service", F.posexplode("controllers").alias("c", "k")).select("system", "pos", "service", "c", "k", F.posexplode("k.methods").alias("m", "x")).where(given(F.col("x")))
    entity = F.concat_ws(".", "k.name", "x.name")
    verb = F.upper(F.trim("x.httpMethod"))
    line = F.format_string("%s %s is implemented by %s in service '%s' (%s).", verb, F.trim("x.url"), entity, "service", F.coalesce(_known("k.path"), F.lit("N/A")))
    of_endpoint = each.select("system", "pos", "c", "m", "service", F.lit("ENDPOINT").alias("entity_type"), entity.alias("entity"), verb.alias("http_method"), F.trim("x.url").alias("url"), line.alias("content"))
    rows = of_service.unionByName(of_endpoint) if endpoints else of_service
    kept = rows.groupBy("system").agg(F.slice(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "system")))), 1, max_items).alias("rows"))  # a system's rows, all of one document
    return kept.select("system", F.posexplode("rows").alias("place", "x")).select("system", "place", F.lit(version).alias("version"), "x.service", "x.entity_type", "x.entity", "x.http_method", "x.url", "x.content")


def component_counts(ir: DataFrame) -> DataFrame:
    """system, role, n: classes of each role."""
    return classes(ir).groupBy("system", "role").agg(F.count("*").alias("n"))


def god_services(ir: DataFrame, least: int = 4) -> DataFrame:
    """system, service, n: services of so many controllers and service classes in all."""
    n = F.coalesce(F.size(F.coalesce("s.controllers", F.array())), F.lit(0)) + F.size(F.coalesce("s.services", F.array()))
    return services(ir).select("system", "service", n.alias("n")).where(F.col("n") >= least)


_GRAPH = "nodes array<struct<nodeName: string, id: string, nodeType: string, dependencies: array<struct<nodeName: string>>, targets: array<struct<nodeName: string>>>>, links array<struct<source: string, target: string>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and links (src, dst) of a service graph in any of three layouts: links of their own with nodes by name or by id, or targets listed with each node (dependencies, which say the same backwards, are read too)."""
    g = spark.read.schema(_GRAPH).option("multiLine", True).json(path)
    n = g.select(F.explode("nodes").alias("n")).select(F.coalesce("n.nodeName", "n.id").alias("id"), F.col("n.nodeType").alias("type"), "n.targets", "n.dependencies").where("id is not null")
    own = g.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"))
    to = n.select(F.col("id").alias("src"), F.explode("targets").alias("t")).select("src", F.col("t.nodeName").alias("dst"))
    back = n.select("id", F.explode("dependencies").alias("t")).select(F.col("t.nodeName").alias("src"), F.col("id").alias("dst"))
    return n.select("id", "type").dropDuplicates(["id"]), own.union(to).union(back).where("src is not null and dst is not null").distinct()
