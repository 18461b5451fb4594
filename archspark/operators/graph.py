"""Graph operators over edges(src, dst) and nodes(id)."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in local mode, an error elsewhere."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


#: Rows that a round of a search may send to all tasks, by way of the driver.
FEW = 20_000


def sent(df: DataFrame) -> DataFrame:
    """A checkpointed side of a join: sent to all tasks where it has few rows, else both sides are shuffled, so that what passes through the driver doesn't grow with the graph."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def degrees(nodes: DataFrame, edges: DataFrame, bottleneck: int = 2, megaservice: int = 2) -> DataFrame:
    """In- and out-degree of every node (0 without links), and whether they exceed the thresholds."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = nodes.join(counts, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))
    return out.select("*", (F.col("in_degree") > bottleneck).alias("bottleneck"), (F.col("out_degree") > megaservice).alias("megaservice"))


def reachable(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): nodes on a path of one edge or more from each start (all sources by default), at their least depth.

    A frontier is joined to the edges and freed of what was reached before, until it is empty; each round is checkpointed.
    """
    edges = edges.select("src", "dst").distinct()
    first = edges if starts is None else edges.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    seen = frontier = checkpointed(first.select("src", "dst", F.lit(1).alias("depth")))
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = checkpointed(step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc, size, cyclic): strongly connected component named by its smallest id; cyclic where it has several members.

    By colouring, with rows in proportion to nodes and edges: edges that no cycle can hold are trimmed, every node takes the
    smallest id that reaches it for its colour, and of a colour those that reach the node it is named by are a component. These
    go, and the rest is coloured anew until no edge is left.
    """
    left = checkpointed(edges.select("src", "dst").where("src != dst").distinct())
    cycles = []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colour = _coloured(left)
        c = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"c_{end}"))
        within = checkpointed(left.join(c("src").hint("merge"), "src").join(c("dst").hint("merge"), "dst").where("c_src = c_dst").select("src", "dst"))
        members = frontier = checkpointed(colour.where("id = colour"))
        while not frontier.isEmpty():
            step = within.join(sent(frontier).select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            frontier = checkpointed(step.join(members.hint("merge"), "id", "left_anti"))
            members = members.union(frontier)
        members = checkpointed(members)
        cycles.append(members)
        left = checkpointed(left.join(members.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti").join(members.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti"))
    named = nodes.select("id", F.col("id").alias("scc"))
    if cycles:
        of = reduce(DataFrame.union, cycles)
        named = nodes.select("id").join(of.hint("merge"), "id", "left").select("id", F.coalesce("colour", "id").alias("scc"))
    sizes = named.groupBy("scc").agg(F.count("*").alias("size"))
    return named.join(sizes.hint("merge"), "scc").select("id", "scc", "size", (F.col("size") > 1).alias("cyclic"))


def condensation(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(id, scc) of `components` -> (src, dst): the distinct links between different components; no path of them comes back."""
    m = members.select("id", "scc")
    ends = edges.join(m.select(F.col("id").alias("src"), F.col("scc").alias("a")).hint("merge"), "src").join(m.select(F.col("id").alias("dst"), F.col("scc").alias("b")).hint("merge"), "dst")
    return ends.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def accumulated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, bits: flags as a long), edges -> id, bits: a node's flags and those of all it reaches.

    Flags are pushed along the condensation, level by level from the components that call none: a component has its members'
    and its successors'. Each link is looked at in one round only, so rows are in proportion to edges, whatever is reachable.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    members = checkpointed(components(nodes.select("id"), edges).select("id", "scc"))
    open_ = checkpointed(condensation(members, edges))
    own = checkpointed(nodes.join(members.hint("merge"), "id").groupBy("scc").agg(F.bit_or("bits").alias("bits")))
    level = own.join(open_.select(F.col("src").alias("scc")).distinct().hint("merge"), "scc", "left_anti")
    done = [level := checkpointed(level)]
    waiting = checkpointed(own.join(open_.groupBy(F.col("src").alias("scc")).agg(F.count("*").alias("calls")).hint("merge"), "scc"))
    while not waiting.isEmpty():
        told = open_.join(sent(level).select(F.col("scc").alias("dst"), F.col("bits").alias("theirs")), "dst").groupBy(F.col("src").alias("scc")).agg(F.bit_or("theirs").alias("theirs"), F.count("*").alias("n"))
        heard = waiting.join(told.hint("merge"), "scc", "left").select("scc", F.col("bits").bitwiseOR(F.coalesce("theirs", F.lit(0))).alias("bits"), (F.col("calls") - F.coalesce("n", F.lit(0))).alias("calls"))
        heard = checkpointed(heard)
        done.append(level := heard.where("calls = 0").select("scc", "bits"))
        waiting = heard.where("calls > 0")
    return members.join(reduce(DataFrame.union, done).hint("merge"), "scc").select("id", "bits")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has a way in and whose end a way out, again and again."""
    n = edges.count()
    while True:
        edges = checkpointed(edges.join(edges.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi"))
        before, n = n, edges.count()
        if n == before:
            return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest id that reaches each node, itself included; only nodes whose colour changed pass theirs on."""
    now = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("colour")))
    moved = now
    while not moved.isEmpty():
        passed = edges.join(sent(moved).select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offered"))
        both = checkpointed(now.join(passed.hint("merge"), "id", "left").select("id", F.least("colour", F.coalesce("offered", "colour")).alias("colour"), (F.col("offered") < F.col("colour")).alias("changed")))
        now, moved = both.select("id", "colour"), both.where("changed").select("id", "colour")
    return now


def longest_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, length): most edges on a path from the start to a leaf that takes no edge twice; 0 from a node without edges, and where no leaf is reached.

    Nodes all of whose successors are known get one more than the longest of them, round by round. Only from nodes that reach a
    cycle are paths followed one by one, within those nodes, until none can go on.
    """
    edges = edges.select("src", "dst").distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = checkpointed(nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("length")))
    frontier, open_ = known, checkpointed(edges)
    while not frontier.isEmpty() and not open_.isEmpty():
        waiting = open_.join(known.select(F.col("id").alias("dst"), "length"), "dst", "left")
        ready = waiting.groupBy("src").agg(F.max("length").alias("length"), F.count_if(F.col("length").isNull()).alias("missing")).where("missing = 0")
        frontier = checkpointed(ready.select(F.col("src").alias("id"), (F.col("length") + 1).alias("length")))
        known = checkpointed(known.union(frontier))
        open_ = checkpointed(open_.join(frontier.select(F.col("id").alias("src")), "src", "left_anti"))
    found = starts.select("id").join(known, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))
    if open_.isEmpty():
        return found
    exits = open_.join(known.select(F.col("id").alias("dst"), "length"), "dst").groupBy(F.col("src").alias("at")).agg((F.max("length") + 1).alias("length"))
    inside = checkpointed(open_.join(known.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", F.xxhash64("src", "dst").alias("e")))
    paths = checkpointed(starts.select("id").join(known, "id", "left_anti").select("id", F.col("id").alias("at"), F.array().cast("array<long>").alias("used")))
    while not paths.isEmpty():
        found = checkpointed(found.union(paths.join(exits, "at").select("id", (F.col("length") + F.size("used")).alias("length"))).groupBy("id").agg(F.max("length").alias("length")))
        paths = checkpointed(paths.join(inside, paths["at"] == inside["src"]).where("not array_contains(used, e)").select("id", F.col("dst").alias("at"), F.array_append("used", F.col("e")).alias("used")))
    return found


def call_chain(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """calls(src, pos, dst), roots(id) -> (root, node, position, depth, cycles): depth-first order from each root, calls of a node by pos, each node visited once.

    cycles says whether any call leads to a node visited before (also where two ways meet). Where most of what the roots reach
    are roots themselves, a node's order is put together from those of the nodes it calls (`_put_together`). What is left, roots
    that reach a cycle or a few roots of a large graph, is searched by path (`_searched`). No side of a join that grows with the
    graph is sent to all tasks, whatever Spark takes its size to be.
    """
    calls = checkpointed(calls.select("src", F.col("pos").cast("int").alias("pos"), "dst").where("dst is not null").distinct())
    roots = checkpointed(roots.select("id").where("id is not null").distinct())
    reached = frontier = roots
    while not frontier.isEmpty():
        called = calls.join(sent(frontier.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(called.join(reached.hint("merge"), "id", "left_anti"))
        reached = reached.union(frontier)
    reached = checkpointed(reached)
    n_roots, n_reached = roots.count(), reached.count()
    if n_reached > 2 * n_roots:
        return _searched(calls, roots)
    done, left = _put_together(checkpointed(calls.join(reached.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi")), reached)
    if n_reached > n_roots:
        done = done.join(roots.select(F.col("id").alias("root")).hint("merge"), "root", "left_semi")
    left = checkpointed(roots.join(left.hint("merge"), "id", "left_semi"))
    return done if left.isEmpty() else done.unionByName(_searched(calls, left))


def _put_together(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `call_chain` for every node that reaches no cycle, and the nodes that do.

    From the nodes without calls upwards: a node's order is itself, then the orders of the nodes it calls, one behind the other,
    each node where it comes first. For what the first of them reaches is closed: no way to other nodes leads through it. Each
    row is made once for each call that leads to it, and not again for each way.
    """
    by = Window.partitionBy("root")
    waiting = checkpointed(calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls")))
    ready, levels = checkpointed(nodes.join(waiting.hint("merge"), "id", "left_anti")), []
    while not ready.isEmpty():
        now = sent(ready)
        rows = ready.select(F.col("id").alias("root"), F.col("id").alias("node"), F.struct(F.lit(0).alias("behind"), F.lit(0).alias("pos"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("depth")).alias("key"), F.lit(False).alias("cycles"))
        if levels:
            below = reduce(DataFrame.union, levels).withColumnRenamed("root", "dst")
            made = calls.join(now.select(F.col("id").alias("src")), "src", "left_semi").join(below.hint("merge"), "dst")
            rows = rows.union(made.select("src", "node", F.struct(F.lit(1).alias("behind"), "pos", "dst", "position", (F.col("depth") + 1).alias("depth")), "cycles"))
        met = rows.repartition("root").groupBy("root", "node").agg(F.min("key").alias("key"), (F.bool_or("cycles") | (F.count("*") > 1)).alias("cycles"))
        place = (F.row_number().over(by.orderBy("key")) - 1).cast("long")
        levels.append(checkpointed(met.select("root", "node", place.alias("position"), F.col("key.depth").alias("depth"), F.max("cycles").over(by).alias("cycles"))))
        told = calls.join(now.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        heard = checkpointed(waiting.join(told.hint("merge"), "id", "left").select("id", (F.col("calls") - F.coalesce("n", F.lit(0))).alias("calls")))
        ready, waiting = heard.where("calls = 0").select("id"), heard.where("calls > 0")
    if not levels:
        return nodes.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("depth"), F.lit(False).alias("cycles")).where("false"), waiting.select("id")
    return reduce(DataFrame.union, levels), waiting.select("id")


def _searched(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of `call_chain` by path.

    The path by which a depth-first search finds a node is the least, by positions, of all paths to it without a repeated node,
    so every node keeps its least path so far, and improved paths are passed on until none improves. Sorting by path gives the
    order.
    """
    best = checkpointed(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.array().cast("array<int>").alias("path"), F.array("id").alias("nodes")).distinct())
    moved = best
    while not moved.isEmpty():
        step = moved.join(calls.hint("merge"), moved["node"] == calls["src"]).where("not array_contains(nodes, dst)").select("root", F.col("dst").alias("node"), F.array_append("path", F.col("pos")).alias("path"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        offered = step.groupBy("root", "node").agg(F.min(F.struct("path", "nodes")).alias("new"))
        moved = checkpointed(offered.join(best.hint("merge"), ["root", "node"], "left").where("path is null or new.path < path").select("root", "node", "new.path", "new.nodes"))
        best = checkpointed(best.join(moved.hint("merge"), ["root", "node"], "left_anti").unionByName(moved))
    made = best.join(calls.hint("merge"), best["node"] == calls["src"]).groupBy("root").agg(F.count("*").alias("n_calls"))
    reached = best.groupBy("root").agg(F.count("*").alias("n"))
    cycles = reached.join(made.hint("merge"), "root", "left").select("root", (F.coalesce("n_calls", F.lit(0)) > F.col("n") - 1).alias("cycles"))
    place = (F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1).cast("long")
    return best.select("root", "node", place.alias("position"), F.size("path").alias("depth")).join(cycles.hint("merge"), "root")


def local_descent(local: DataFrame, remote: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls to other services from inside a method and the methods it calls locally: local(src, pos, dst), remote(method, pos, target), roots(id) -> rows (root, place, method, pos, depth, target) in depth-first order, and by root n_remote, local_methods, max_local_depth and nested.

    Every method is entered once, the root itself again where a call leads back to it; nested counts a call once for each
    level that it lies below the root. Remote calls are leaves of the call chain, so that they keep their place between local ones.
    """
    node = lambda kind, c, pos=None: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"), (F.lit(-1) if pos is None else F.col(pos)).cast("int").alias("pos"))
    tops = roots.select(F.col("id").cast("string").alias("id")).distinct()
    steps = local.where("dst is not null").select(node("method", "src").alias("src"), "pos", node("method", "dst").alias("dst"))
    leaves = remote.select(node("method", "method").alias("src"), "pos", node("remote", "method", "pos").alias("dst"))
    first = local.where("dst is not null").join(tops, F.col("src").cast("string") == tops["id"], "left_semi").select(node("root", "src").alias("src"), "pos", node("method", "dst").alias("dst"))
    own = remote.join(tops, F.col("method").cast("string") == tops["id"], "left_semi").select(node("root", "method").alias("src"), "pos", node("own", "method", "pos").alias("dst"))
    chain = checkpointed(call_chain(steps.union(leaves).union(first).union(own), tops.select(node("root", "id").alias("id"))).select(F.col("root.id").alias("root"), F.col("node.kind").alias("kind"), F.col("node.id").alias("method"), F.col("node.pos").alias("pos"), "position", "depth"))
    called = F.col("kind").isin("own", "remote")
    targets = remote.select(F.col("method").cast("string").alias("method"), F.col("pos").cast("int").alias("pos"), "target")
    rows = chain.where(called).join(targets, ["method", "pos"]).select("root", (F.row_number().over(Window.partitionBy("root").orderBy("position")) - 1).alias("place"), "method", "pos", (F.col("depth") - 1).alias("depth"), "target")
    inside = F.col("kind") == "method"
    counts = chain.groupBy("root").agg(F.count_if(called).alias("n_remote"), F.count_if(inside).alias("local_methods"), F.coalesce(F.max(F.when(inside, F.col("depth"))), F.lit(0)).alias("max_local_depth"), F.coalesce(F.sum(F.when(called, F.col("depth") - 1)), F.lit(0)).alias("nested"))
    kind = roots.schema["id"].dataType
    return rows.withColumn("root", F.col("root").cast(kind)), counts.withColumn("root", F.col("root").cast(kind))


def chain_statistics(chain: DataFrame, required: DataFrame) -> DataFrame:
    """chain of `call_chain`, required(node, roles: array; no row where unresolved) -> by root: calls in all, resolved and not, greatest depth, public (no roles) and restricted ones, cycles."""
    rows = chain.join(required.hint("merge"), "node", "left")
    n = lambda c: F.count_if(c)
    return rows.groupBy("root").agg(F.count("*").alias("total"), n(F.col("roles").isNotNull()).alias("resolved"), n(F.col("roles").isNull()).alias("unresolved"), F.max("depth").alias("max_depth"), n(F.size("roles") == 0).alias("public"), n(F.size("roles") > 0).alias("restricted"), F.bool_or("cycles").alias("cycles"))


def corpus_statistics(statistics: DataFrame) -> DataFrame:
    """Sums over the roots of `chain_statistics`, roots with cycles, and mean (two digits, half to even), least and greatest length."""
    return statistics.agg(F.count("*").alias("roots"), *(F.sum(c).alias(c) for c in ("total", "resolved", "unresolved")), F.count_if("cycles").alias("with_cycles"), F.bround(F.avg("total"), 2).alias("mean_length"), F.min("total").alias("min_length"), F.max("total").alias("max_length"))


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """pairs(src, dst) -> every path between them without a repeated node, of at most max_depth edges: src, dst, nodes."""
    edges = edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    paths = checkpointed(pairs.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("nodes")).distinct())
    found = paths.where("at = dst").select("src", "dst", "nodes")
    for _ in range(max_depth):
        paths = checkpointed(paths.where("at != dst").join(edges, "at").where("not array_contains(nodes, next)").select("src", "dst", F.col("next").alias("at"), F.array_append("nodes", F.col("next")).alias("nodes")))
        if paths.isEmpty():
            break
        found = found.union(paths.where("at = dst").select("src", "dst", "nodes"))
    return found


def subgraph(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, src, dst): edges on paths of at most max_depth edges from each start(id); none for a start without edges."""
    near = reachable(edges, start, max_depth - 1).select(F.col("src").alias("root"), F.col("dst").alias("src")).union(start.select(F.col("id").alias("root"), F.col("id").alias("src"))).distinct()
    return near.join(edges.select("src", "dst").distinct(), "src").select("root", "src", "dst")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other, direction): what every node is linked to, both ways, repetitions kept."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction")).union(edges.select("dst", "src", F.lit("in")))


def smell_counts(nodes: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Counts at a threshold: cyclic components, bottlenecks and megaservices (degree above it), highly coupled nodes (links of both directions above it)."""
    d = degrees(nodes, edges, threshold, threshold)
    high = F.count_if(F.col("in_degree") + F.col("out_degree") > threshold)
    cyclic = components(nodes, edges).where("cyclic").agg(F.countDistinct("scc").alias("cyclic"))
    return d.agg(F.count_if("bottleneck").alias("bottlenecks"), F.count_if("megaservice").alias("megaservices"), high.alias("coupled")).crossJoin(cyclic)  # one row each


def diff(old: DataFrame, new: DataFrame, key: list[str], detail: str) -> DataFrame:
    """Keyed three-way diff: added, removed, unmodified, or modified where both sides have the key but `detail` differs."""
    a, b = (df.select(*key, F.col(detail).alias(side)) for df, side in ((old, "before"), (new, "after")))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unmodified").otherwise("modified")
    return a.withColumn("in_old", F.lit(1)).join(b.withColumn("in_new", F.lit(1)), key, "full").select(*key, "before", "after", state.alias("state"))


def profile(edges: DataFrame) -> DataFrame:
    """Per snapshot of edges(snapshot, src, dst), self loops left out: nodes, edges, coupling, density, hubs (degree over 1.5 times the mean), leaves (degree 1), internal."""
    edges = edges.where("src != dst").select("snapshot", "src", "dst").distinct()
    degree = edges.select("snapshot", F.explode(F.array("src", "dst")).alias("id")).groupBy("snapshot", "id").agg(F.count("*").alias("d"))
    mean = F.avg("d").over(Window.partitionBy("snapshot"))
    marks = degree.select("snapshot", (F.col("d") > 1.5 * mean).cast("int").alias("hub"), (F.col("d") <= 1).cast("int").alias("leaf"), "d")
    out = marks.groupBy("snapshot").agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.sum("hub").alias("hubs"), F.sum("leaf").alias("leaves"))
    return out.select("*", F.greatest(F.lit(0), F.col("nodes") - F.col("hubs") - F.col("leaves")).alias("internal"), F.round(F.col("edges") / F.col("nodes"), 2).alias("coupling"), F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 3).alias("density"))


def calls_to_links(calls: DataFrame, urls: DataFrame) -> DataFrame:
    """Link services by the URLs they call: calls(src, url, request), urls(url, service, pos); of several services for one URL the last is meant. One row per (src, dst) with its requests, sorted."""
    owner = urls.groupBy("url").agg(F.max_by("service", "pos").alias("dst"))
    return calls.join(owner, "url").where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n_requests"), F.array_sort(F.collect_set("request")).alias("requests"))


def pending_targets(calls: DataFrame) -> DataFrame:
    """calls(method, pos, target, is_rest): a target named by a call is meant by the next REST call of the same method, and by that one only; null where none was named (an external call)."""
    by = Window.partitionBy("method").orderBy("pos")
    stretch = F.coalesce(F.sum(F.col("is_rest").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("method", "stretch").orderBy("pos")
    return calls.withColumn("stretch", stretch).withColumn("meant", F.last("target", ignorenulls=True).over(within)).where("is_rest").select("method", "pos", "meant")


def chatty(calls: DataFrame) -> DataFrame:
    """calls(method, pos, src, dst, order): external calls numbered within their method; cyclic where the reverse link came before, else chatty from the second on."""
    external = calls.where("src != dst")
    first = external.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("order").alias("reverse"))
    nth = F.row_number().over(Window.partitionBy("method").orderBy("pos"))
    tag = F.when(F.col("reverse") < F.col("order"), "cyclic").when(F.col("nth") > 1, "chatty").otherwise("none")
    return external.withColumn("nth", nth).join(first, ["src", "dst"], "left").select("method", "pos", "src", "dst", F.col("nth").cast("long").alias("nth"), tag.alias("tag"))


def coupling(edges: DataFrame, threshold: int) -> DataFrame:
    """(id, neighbours, colour): distinct neighbours in either direction, self loops left out; red above the threshold, orange above half of it, green else."""
    links = edges.where("src != dst").select("src", "dst")
    both = links.union(links.select("dst", "src")).toDF("id", "other").distinct()
    n = F.col("neighbours")
    colour = F.when(n > threshold, "red").when(n > threshold / 2, "orange").otherwise("green")
    return both.groupBy("id").agg(F.count("*").alias("neighbours")).select("id", "neighbours", colour.alias("colour"))


def shared_imports(imports: DataFrame) -> DataFrame:
    """imports(service, name): the distinct rows whose name more than one service imports."""
    rows = imports.select("service", "name").where("service is not null").distinct()
    return rows.join(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "name", "left_semi").select("service", "name")
