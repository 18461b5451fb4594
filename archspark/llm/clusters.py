"""Centroid clustering in integers: float32 screening with rigorous error intervals, exact integers where they overlap.

A vector's components become integers floor(SCALE * x). The nearest centroid is the one of least |c|^2 - 2 v.c; a float32
matrix product gives v.c for all centroids at once, wrong by (DIMS + 2) units in the last place of |v||c| at most, whatever
the order of summation. That makes an interval for each centroid. Those whose interval reaches below the least upper end stay;
where several do, their squared distances are computed in integers, and the smallest number wins a tie. So the result is
that of exact arithmetic.

Every round is one pass over the stored integers: a task adds up its vectors by centroid and emits the sums in limbs of 32
bits, which Spark adds up by centroid, component and limb; only those (k * DIMS of few limbs) reach the driver. Sums don't
overflow however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import stored

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
SEED = "3:"
#: Below this, squared distances of DIMS components fit 64 bits: 64 * (2 * 2^27)^2 = 2^62. Other vectors are kept as text.
NARROW = 1 << 27
LIMB = 32
#: Error of a float32 product of DIMS components, both rounded to float32 before, as a share of |v||c|; half as much again for its own rounding.
_UNIT = 2.0**-24
RELATIVE = 1.5 * (DIMS + 2) * _UNIT / (1 - (DIMS + 2) * _UNIT)

_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _integer(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector -> vec_id, packed (int32 components as bytes) or wide (decimal integers, comma-joined)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        narrow = (np.abs(x) < NARROW // SCALE).all(axis=1)
        ints = np.floor(np.where(narrow[:, None], x, 0) * SCALE).astype(np.int32)
        wide = [None if ok else ",".join(str(_integer(v)) for v in row) for ok, row in zip(narrow, x.tolist())]
        packed = [row.tobytes() if ok else None for ok, row in zip(narrow, ints)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(wide, pa.string())], names=["vec_id", "packed", "wide"])


def kept(embeddings: DataFrame) -> DataFrame:
    """The vectors of exactly DIMS components, none null or non-finite, as integers."""
    x = F.col("embedding").cast("array<double>")
    whole = embeddings.select(F.col("vec_id").cast("long"), x.alias("vector")).where((F.size("vector") == DIMS) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return whole.mapInArrow(_packed, "vec_id long, packed binary, wide string")


class Nearest:
    """Assigns integer vectors to the nearest of some integer centroids, exactly."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.wide = any(abs(x) >= NARROW for c in centroids for x in c)
        if not self.wide:
            self.exact = np.array(centroids, np.int64)
            self.single = self.exact.astype(np.float32)
            self.squares = (self.exact**2).sum(axis=1).astype(float)
            self.norms = np.sqrt(self.squares) * (1 + 1e-12)

    def screened(self, v: np.ndarray) -> np.ndarray:
        """Which centroids of each int64 vector may be the nearest, by float32 products and their intervals."""
        norms = np.sqrt((v * v).sum(axis=1).astype(float)) * (1 + 1e-12)
        products = (v.astype(np.float32) @ self.single.T).astype(float)
        value = self.squares - 2 * products
        error = 2 * RELATIVE * np.outer(norms, self.norms) + 2.0**-50 * (self.squares + 2 * np.abs(products)) + 1e-30
        return value - error <= (value + error).min(axis=1)[:, None]

    def labels(self, v: np.ndarray) -> np.ndarray:
        """Numbers of the nearest centroids of int64 vectors below NARROW."""
        if self.wide:
            return np.array([self.plain(row)[0] for row in v.tolist()], np.int64)
        open_ = self.screened(v)
        best = open_.argmax(axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(unsure):
            row, number = np.nonzero(open_[unsure])
            exact = np.full((len(unsure), len(self.centroids)), np.iinfo(np.int64).max)
            exact[row, number] = ((v[unsure[row]] - self.exact[number]) ** 2).sum(axis=1)
            best[unsure] = exact.argmin(axis=1)
        return best

    def distances(self, v: np.ndarray, labels: np.ndarray) -> list[int]:
        if self.wide:
            return [self.plain(row)[1] for row in v.tolist()]
        return ((v - self.exact[labels]) ** 2).sum(axis=1).tolist()

    def plain(self, row: list[int]) -> tuple[int, int]:
        """Number and squared distance for integers of any size."""
        every = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in self.centroids]
        best = min(range(len(every)), key=every.__getitem__)
        return best, every[best]


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Rows below NARROW and their int64 components; the other rows' integers."""
    packed, wide = batch.column(1), batch.column(2)
    at = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
    v = np.frombuffer(b"".join(packed.drop_null().to_pylist()), np.int32).reshape(-1, DIMS).astype(np.int64)
    return at, v, [(i, [int(x) for x in t.split(",")]) for i, t in enumerate(wide.to_pylist()) if t is not None]


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """x as limb numbers and values; all but the last are below 2 ** LIMB, the last has the sign."""
    k = 0
    while not -(1 << LIMB) < x < (1 << LIMB):
        yield k, x & ((1 << LIMB) - 1)
        x, k = x >> LIMB, k + 1
    yield k, x


_SUMS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def _sums(centroids: list[list[int]]):
    """A task's sums by centroid, component and limb; component -1 counts vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, total = Nearest(centroids), [[0] * (DIMS + 1) for _ in centroids]
        for batch in batches:
            _, v, wide = _read(batch)
            labels = nearest.labels(v)
            for c in np.unique(labels).tolist():
                own = v[labels == c]
                for j, x in enumerate((*own.sum(axis=0).tolist(), len(own))):
                    total[c][j] += x
            for _, row in wide:
                own = total[nearest.plain(row)[0]]
                for j, x in enumerate((*row, 1)):
                    own[j] += x
        rows = [(c, j if j < DIMS else -1, k, value) for c, own in enumerate(total) if own[-1] for j, x in enumerate(own) for k, value in _limbs(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)

    return run


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid that has vectors becomes the floor of their mean, by component."""
    sums = vectors.mapInArrow(_sums(centroids), "cluster int, component int, limb int, value long").groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        total[r["cluster"], r["component"]] = total.get((r["cluster"], r["component"]), 0) + (r["value"] << LIMB * r["limb"])
    return [[total.get((c, j), 0) // total[c, -1] for j in range(DIMS)] if (c, -1) in total else own for c, own in enumerate(centroids)]


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors whose hashed ids are smallest, in order; a null id comes last, equal ids go by their vectors."""
    key = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), F.col("packed").asc_nulls_last(), "wide").limit(clusters).collect()
    return [np.frombuffer(r["packed"], np.int32).tolist() if r["packed"] is not None else [int(x) for x in r["wide"].split(",")] for r in first]


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    centroids = seeds(vectors, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids)
        for batch in batches:
            at, v, wide = _read(batch)
            cluster, distance = [0] * batch.num_rows, [0] * batch.num_rows
            labels = nearest.labels(v)
            for i, c, d in zip(at.tolist(), labels.tolist(), nearest.distances(v, labels)):
                cluster[i], distance[i] = c, d
            for i, row in wide:
                cluster[i], distance[i] = nearest.plain(row)
            fits = [d if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def clusters(embeddings: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Cluster, squared distance and sums of distances of every kept vector.

    Rows of one vec_id are vectors of their own. With fewer vectors than centroids each is one. A distance or sum that 64
    bits can't hold is null (assignment and centroids are exact for any size). An empty table, or one without a vector to
    keep, gives no rows; columns other than vec_id and embedding are ignored.
    """
    spark = embeddings.sparkSession
    vectors = stored(kept(embeddings), "clusters-vectors")
    centroids = fit(vectors, count, rounds)
    if not centroids:
        return spark.createDataFrame([], _SCHEMA)
    found = stored(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters-found")
    by = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count(F.when(F.col("distance").isNull(), 1)).alias("lost")).collect()}
    sums = [None if c in by and by[c]["lost"] else int(by[c]["total"]) if c in by else 0 for c in range(len(centroids))]
    every = None if None in sums else sum(sums)

    def fits(x: int | None):
        return F.lit(x if x is not None and x < 1 << 63 else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.col("cluster") + 1
    return found.select("vec_id", "cluster", "distance", F.element_at(F.array(*map(fits, sums)), own).alias("cluster_inertia"), fits(every).alias("inertia"), F.element_at(F.array(*map(F.lit, digests)), own).alias("centroid_sha256"))
