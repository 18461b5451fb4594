"""Merkle dataset manifest: a hash tree per source, a tree over the sources, and a proof for every document.

Proofs are looked up by coordinate. A coordinate (tree, level, run) names WIDTH consecutive nodes. From its index and its
tree's size alone a leaf knows which runs lie on its way to the root, and its own place in each; those runs hold its
siblings. The leaves of one bottom run need the same coordinates, so each bottom run explodes them once, joins the stored
node table, and keeps what it found in order; each leaf then drops itself from every run, concatenates, and folds.

A run near the root is wanted by very many bottom runs, so blocks of 4096 leaves ask for what lies above them once for all
of theirs. Leaves get their index from one range sort by source and id, so that a large source fills many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archspark.llm.common import crc_mod, ranges, stored

#: Nodes that are hashed together are 2 ** BITS; a block is as many leaves as INNER levels hold; a tree has LEVELS at most.
BITS, INNER, LEVELS = 4, 3, 15
WIDTH = 1 << BITS
#: The tree over the sources; sources are numbered from 1.
TOP = 0
TAMPER = 5

_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def leaf(text: Column) -> Column:
    """The digest of a document's row, with the text given."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def _height(n: Column) -> Column:
    """Levels below a tree's root: the least h with WIDTH ** h >= n."""
    return sum((n > (1 << BITS * k)).cast("int") for k in range(LEVELS))


def indexed(leaves: DataFrame) -> DataFrame:
    """leaves(row, source, doc_id, leaf, ...) -> with tree (the source's rank, from 1), n (its leaves) and i (index in it).

    One range sort; each task's rows are numbered where they lie, and a small table with a row for each task and source
    says how many come before. That table has a row for each task and one for each source, and is joined as its size allows.
    """
    sort = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = leaves.repartitionByRange(ranges(leaves), *sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.withColumns({"task": F.shiftright("at", 33), "name": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}), "manifest-placed")
    pieces = stored(placed.groupBy("name", "task").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "manifest-pieces")
    of_name, in_order = Window.partitionBy("name"), Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    within = pieces.withColumns({"before": F.coalesce(F.sum("rows").over(of_name.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("rows").over(of_name), "begins": F.min("task").over(of_name) == F.col("task")})
    begun = within.where("begins").select("name", "task", "first")
    earlier = begun.groupBy("task").agg(F.count("*").alias("c")).select("task", F.coalesce(F.sum("c").over(in_order), F.lit(0)).alias("earlier"))
    rank = begun.join(earlier, "task").select("name", (F.col("earlier") + F.row_number().over(Window.partitionBy("task").orderBy("first"))).alias("tree"))
    found = stored(within.join(rank, "name").select("name", "task", "first", "before", "n", "tree"), "manifest-trees")
    return placed.join(found, ["name", "task"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "task", "first", "before", "name")


def grown(nodes: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """nodes(tree, n, i, digest) -> the node table runs(tree, n, level, run, digests) and roots(tree, digest)."""
    levels, roots, level = [], [], 0
    while True:
        roots.append(nodes.where(_height(F.col("n")) == level).select("tree", "digest"))
        nodes = nodes.where(_height(F.col("n")) > level)
        listed = nodes.groupBy("tree", F.shiftright("i", BITS).alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("all"))
        runs = stored(listed.select("tree", "n", F.lit(level).alias("level"), "run", F.col("all.digest").alias("digests")), f"manifest-{what}-{level}")
        if runs.isEmpty():
            break
        levels.append(runs)
        nodes, level = runs.select("tree", "n", F.col("run").alias("i"), F.sha2(F.array_join("digests", ""), 256).alias("digest")), level + 1
    every, top = (levels or [runs])[0], roots[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    for x in roots[1:]:
        top = top.unionByName(x)
    return every, top


def _steps(levels: str, run: str, place: str, tree: str = "tree") -> str:
    return f"transform({levels}, k -> named_struct('at', {'k' if tree == 'tree' else f'{LEVELS} + k'}, 'tree', {tree}, 'level', k, 'run', {run}, 'place', {place}))"


def looked_up(askers: DataFrame, key: list[str], coordinates: str, runs: DataFrame) -> DataFrame:
    """Explode each asker's coordinates, join the node table, and gather what was found, in order, as path(place, digests)."""
    asked = askers.select(*key, F.explode_outer(F.expr(coordinates)).alias("c"))
    at = [F.col(f"c.{x}") == runs[x] for x in ("tree", "level", "run")]
    found = asked.join(runs, at, "left").select(*(asked[k] for k in key), F.when(F.col("c").isNotNull(), F.struct("c.at", "c.place", "digests")).alias("found"))
    return found.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list("found")), lambda x: F.struct(x["place"], x["digests"])).alias("path"))


def proofs(leaves: DataFrame, runs: DataFrame, subroots: DataFrame, sources: int) -> DataFrame:
    """leaves(tree, n, i, ...) -> with path and subroot.

    Blocks of 4096 leaves look up what lies above them, once; a run within a block is asked for by 256 bottom runs at most.
    """
    b, m = BITS, WIDTH - 1
    top = sum(sources > (1 << b * k) for k in range(LEVELS))
    over = _steps(f"sequence(0, {top - 1})", f"shiftright(tree - 1, {b} * (k + 1))", f"int(shiftright(tree - 1, {b} * k) & {m})", f"{TOP}L") if top else "filter(array(named_struct('at', 0, 'tree', 0L, 'level', 0, 'run', 0L, 'place', 0)), k -> false)"
    above = _steps(f"filter(sequence(0, {LEVELS}), k -> k >= {INNER} and k < height)", f"shiftright(block, {b} * (k - {INNER - 1}))", f"int(shiftright(block, {b} * (k - {INNER})) & {m})")
    below = _steps(f"filter(sequence(0, {INNER - 1}), k -> k < height)", f"shiftright(low, {b} * k)", f"if(k = 0, null, int(shiftright(low, {b} * (k - 1)) & {m}))")
    placed = leaves.withColumns({"low": F.shiftright("i", BITS), "block": F.shiftright("i", BITS * INNER), "height": _height(F.col("n"))})
    bottom = placed.select("tree", "block", "low", "height").distinct()
    blocks = bottom.select("tree", "block", "height").distinct()
    upper = looked_up(blocks, ["tree", "block"], f"concat({above}, {over})", runs).withColumnRenamed("path", "upper").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    lower = looked_up(bottom, ["tree", "block", "low"], below, runs)
    way = lower.join(upper, ["tree", "block"]).select("tree", "low", "subroot", F.concat("path", "upper").alias("path"))
    return placed.join(way, ["tree", "low"])


def _siblings(step: Column, i: Column) -> tuple[Column, Column]:
    """What stands before and after the own node in a run of the path, as text."""
    place = F.coalesce(step["place"], i.bitwiseAND(F.lit(WIDTH - 1)).cast("int"))
    return F.array_join(F.slice(step["digests"], F.lit(1), place), ""), F.array_join(F.slice(step["digests"], place + 2, F.lit(WIDTH)), "")


def proof_digest(path: Column, i: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(*_siblings(p, i))), ""), 256)


def folded(start: Column, path: Column, i: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(digest, p):
        before, after = _siblings(p, i)
        return F.sha2(F.concat(before, digest, after), 256)

    return F.aggregate(path, start, step)


def manifest(documents: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root its proof gives after tampering.

    Where 5 divides the crc32 of doc_id, tampering lower-cases A-Z of the text; verified says whether the folded root is the
    manifest's. A null field counts as `-`, a null doc_id stands first in its source and is never tampered with; rows of one
    doc_id follow each other by leaf, and equal rows have an index each. A source of one row has its leaf as subroot; the
    proof of the only row there is is empty. An empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    tampered = F.coalesce(crc_mod("doc_id", TAMPER) == 0, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    leaves = stored(rows.select("row", "source", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lowered(F.col("text")))).alias("changed")), "manifest-leaves")
    placed = stored(indexed(leaves).select("tree", "n", "i", "doc_id", "leaf", "changed"), "manifest-indexed")
    runs, subroots = grown(placed.select("tree", "n", "i", F.col("leaf").alias("digest")), "source")
    sources = subroots.count()
    if not sources:
        return spark.createDataFrame([], _SCHEMA)
    top_runs, roots = grown(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("n"), (F.col("tree") - 1).alias("i"), "digest"), "top")
    root = roots.first()["digest"]
    found = proofs(placed, runs.unionByName(top_runs).drop("n"), subroots, sources)
    proof = found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof_digest(F.col("path"), F.col("i")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path"), F.col("i")).alias("folded_root"))
    return proof.withColumn("verified", F.col("folded_root") == F.col("root"))
