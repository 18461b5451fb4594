"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by shingle count into sizes that are powers of two. For a size S, a document is cut into blocks of S
shingles, and each pair of neighbouring blocks is a window, so a passage of an item of that size lies whole in one window.
An item and a window of sizes that near share one of COORDINATES minimum hashes in all but a few of a million cases where
three quarters of the item are in it. Of an item of fewer than LEAST_SIZE shingles, so many shingles are looked up by
themselves that three quarters of the item include one: these are never missed. A bit table of fixed size says which minimum hashes the items have; only windows that
hit it leave the scan, are joined to the items by the hash itself, and verified on the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import SHINGLE, WordHashes, hashed, mixed, row_batches, seeds, shingle_set, shingles, texts, words_of

COORDINATES = 64
LEAST_SIZE = 8
PERCENT = 75
#: log2 of the bits of the table of items' hashes: 1 MB however many items there are; more of them only mean more to join.
TABLE_BITS = 23

#: Stands for the size of items whose shingles are looked up by themselves.
EXACT = 1

_A, _B = seeds(COORDINATES, 23), seeds(COORDINATES, 29)


def _key(values: np.ndarray, k: int, width: int, size: int) -> np.ndarray:
    return mixed(values ^ np.uint64((k << 40) + (width << 32) + size))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    cache = WordHashes()
    for batch in batches:
        for item, item_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            words = words_of(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            s = np.unique(shingles(hashed(words, cache)))
            if len(s) < LEAST_SIZE:
                probes = s[: len(s) - -(-PERCENT * len(s) // 100) + 1]
                yield item, item_hash, width, EXACT, len(s), _key(probes, COORDINATES, width, EXACT).view(np.int64).tolist()
                continue
            size = 1 << (len(s) - 1).bit_length()
            keys = [int(_key(((s ^ _B[k]) * _A[k]).min(keepdims=True), k, width, size)[0].view(np.int64)) for k in range(COORDINATES)]
            yield item, item_hash, width, size, len(s), keys


_ITEMS = pa.schema([("item_id", pa.int64()), ("item_hash", pa.int64()), ("width", pa.int32()), ("size", pa.int64()), ("item_shingles", pa.int64()), ("keys", pa.list_(pa.int64()))])
_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])


def _window_hits(batches: Iterator[pa.RecordBatch], sizes: dict[int, list[int]], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            docs = np.array(part.column(0).to_pylist(), object)
            text_hashes = part.column(1).to_pylist()
            words = [hashed(words_of(t), cache) for t in texts(part.column(2))]
            found: set[tuple[int, int]] = set()
            for width, wanted in sizes.items():
                sets = [(i, shingles(w, width)) for i, w in enumerate(words) if len(w) >= width]
                if not sets:
                    continue
                if EXACT in wanted:
                    owner = np.repeat(np.array([i for i, _ in sets]), [len(s) for _, s in sets])
                    found.update(_hit(_key(np.concatenate([s for _, s in sets]), COORDINATES, width, EXACT), owner, table))
                if larger := [size for size in wanted if size != EXACT]:
                    for size, owner, windows in _windows(sets, larger):
                        for k in range(COORDINATES):
                            found.update(_hit(_key(windows[k], k, width, size), owner, table))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in found], pa.int64()), pa.array([text_hashes[i] for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], schema=_HITS)


def _hit(keys: np.ndarray, owner: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """(owner, key) of the keys that the table may have."""
    bit = keys >> np.uint64(64 - TABLE_BITS)
    hit = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
    return zip(owner[hit].tolist(), keys[hit].view(np.int64).tolist())


def _windows(sets: list[tuple[int, np.ndarray]], wanted: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each wanted size: the document of each window, and its minimum hashes by coordinate. Larger blocks are made from the smallest."""
    least = wanted[0]
    every = np.concatenate([s for _, s in sets])
    counts = np.array([-(-len(s) // least) for _, s in sets])
    first = np.r_[0, np.cumsum([len(s) for _, s in sets])[:-1]]
    starts = np.concatenate([f + least * np.arange(c) for f, c in zip(first, counts)])
    blocks = np.stack([np.minimum.reduceat((every ^ _B[k]) * _A[k], starts) for k in range(COORDINATES)])
    begin = np.r_[0, counts.cumsum()[:-1]]
    for size in wanted:
        step = size // least
        many = -(-counts // step)
        level = np.minimum.reduceat(blocks, np.concatenate([b + step * np.arange(m) for b, m in zip(begin, many)]), axis=1)
        owner = np.repeat(np.array([i for i, _ in sets]), many)
        windows = level.copy()
        near = owner[1:] == owner[:-1]
        windows[:, :-1][:, near] = np.minimum(level[:, :-1][:, near], level[:, 1:][:, near])
        yield size, owner, windows


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, item_shingles, shared, containment.

    A row per document that has at least three quarters of an item's distinct five-word shingles; an item of fewer words
    is one shingle of its own width. Null and empty texts match nothing, an empty table gives no rows, a repeated
    (doc_id, text) gives its rows once; a doc_id with several texts gives its largest containment. Null counts as an id.
    """
    kept = contaminated_rows(documents, benchmark)
    return kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "item_shingles", "shared")).alias("x")).select("doc_id", "item_id", "x.item_shingles", "x.shared", "x.containment")


def contaminated_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As `contaminated`, by row: with text_hash, the xxhash64 of the text, which tells documents without an id apart."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts_of_items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct().select("item_id", F.xxhash64("text").alias("item_hash"), "text")
    items = texts_of_items.mapInArrow(lambda b: row_batches(_item_rows(b), _ITEMS), "item_id long, item_hash long, width int, size long, item_shingles long, keys array<long>")
    sizes: dict[int, list[int]] = {}
    for r in items.select("width", "size").distinct().collect():  # at most five widths by the logarithm of the longest item
        sizes.setdefault(r["width"], []).append(r["size"])
    keyed = items.select("item_id", "item_hash", F.explode("keys").alias("key"))
    bit = keyed.select(F.shiftrightunsigned("key", 64 - TABLE_BITS).alias("bit"))
    bytes_set = bit.groupBy(F.expr("bit >> 3").alias("at")).agg(F.expr("bit_or(1 << cast(bit & 7 as int))").alias("bits")).collect()  # at most 2^20 rows
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in bytes_set:
        bits[r["at"]] = r["bits"]
    sizes = {w: sorted(s) for w, s in sizes.items()}
    hits = docs.mapInArrow(lambda b: _window_hits(b, sizes, bits), "doc_id long, text_hash long, key long")
    pairs = hits.join(keyed.distinct(), "key").select("doc_id", "text_hash", "item_id", "item_hash").distinct()
    d, i = docs.toDF("d_id", "d_hash", "text"), texts_of_items.toDF("i_id", "i_hash", "item_text")
    with_docs = pairs.join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")))
    both = with_docs.join(i, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_hash") == F.col("i_hash"))).select("doc_id", "text_hash", "item_id", "text", "item_text")

    def verified(batches: Iterator[pa.RecordBatch]):
        cache = WordHashes()
        for batch in batches:
            for doc, text_hash, item, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(3)), texts(batch.column(3)), texts(batch.column(4))):
                s = shingle_set(wanted, cache)
                d = shingle_set(text, cache, min(SHINGLE, len(words_of(wanted))))
                shared = len(np.intersect1d(s, d, assume_unique=True))
                if 100 * shared >= PERCENT * len(s):
                    yield doc, text_hash, item, len(s), shared, shared / len(s)

    return both.mapInArrow(lambda b: row_batches(verified(b), _KEPT), "doc_id long, text_hash long, item_id long, item_shingles long, shared long, containment double")
