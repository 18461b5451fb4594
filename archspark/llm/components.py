"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import stored

#: An id of more links than this, and than one in SHARE of all links, is a hub: at most 2 * SHARE ids are.
HUB, SHARE = 1000, 50_000


def _with_least(edges: DataFrame, per: DataFrame, hub: int) -> DataFrame:
    """edges(u, v) with m of per(u, m, n). The hubs' rows of `per`, a bounded number, are broadcast, so their edges stay where they are; the others meet by u."""
    hubs = F.broadcast(per.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(per.where(F.col("n") <= hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, component): the smallest id reachable, for each id that has a link to another.

    Each round finds the least neighbour of every id by aggregation (partial sums first, so that a hub is one row a task) and
    brings it back to the edges; those of hubs aren't shuffled for it. The edge table is written to the shared folder after
    each round. Ends when a round changes nothing.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, hub = now, max(HUB, now[0] // SHARE)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _with_least(large, low, hub).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(low.select("u", "m")).distinct(), "edges")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
