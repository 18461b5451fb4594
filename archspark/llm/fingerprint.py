"""Document fingerprints: threshold-scaled sketches.

A fingerprint keeps every 48-bit shingle hash below FRACTION of the hash range, and the smallest hash of all, so that a
very short text has one too. The sketch of a union is the union of the sketches (`merged`), and containment between
very unequal texts is estimated from the retained hashes alone (`containment`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import WordHashes, partitions, row_batches, shingle_set

#: Share of the hash range that is retained.
FRACTION = 0.25
BITS = 48
LIMIT = np.uint64(int(FRACTION * 2**BITS))


def sketch(text: bytes, cache: WordHashes) -> np.ndarray:
    every = np.unique(shingle_set(text, cache) >> np.uint64(64 - BITS))
    return every[: max(1, int(np.searchsorted(every, LIMIT)))]


def written(s: np.ndarray) -> str:
    """Twelve hex digits per retained hash, ascending."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two texts' shingle sets."""
    both = np.union1d(a, b)
    return both[: max(1, int(np.searchsorted(both, LIMIT)))]


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Sizes of both retained parts and of their intersection; the smallest hashes stand in where either part is empty."""
    x, y = a[a < LIMIT], b[b < LIMIT]
    if not len(x) or not len(y):
        x, y = a[:1], b[:1]
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty texts, 0 for an empty and another."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    n, m, both = _shared(a, b)
    return both / (n + m - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a) or not len(b):
        return float(not len(a))
    n, _, both = _shared(a, b)
    return both / n


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("containment_edited", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a partition are sorted by group and place; each own row meets the row after it."""
    cache, held = WordHashes(), None

    def row(here, following):
        _, _, doc, text, s = here
        edited = _edited(text, following[3])
        raw = edited.encode()
        e = sketch(raw, cache)
        return doc, len(text), hashlib.sha256(raw).hexdigest(), written(s), written(e), likeness(s, e), likeness(s, following[4]), containment(s, e)

    for batch in batches:
        for group, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            now = (group, guest, doc, text, sketch(text.encode(), cache))
            if held is not None and held[0] == group and not held[1]:
                yield row(held, now)
            held = now


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text (its last quarter replaced by the head of the next document).

    Next is by ascending doc_id, after the last comes the first; rows of one doc_id follow each other by text, a null
    doc_id comes first, a null text is empty. An empty text has an empty fingerprint. An empty table gives no rows.
    Documents are dealt into ranges of doc_id cut at values that occur; the first row of each range also goes, as a
    guest, to the range before it, so one shuffle of the texts is all.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    keyed = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(n)], 10_000).alias("c"), F.min("key").alias("m")).first()
    if cuts["m"] is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_edited double")
    starts = sorted({cuts["m"], *cuts["c"]})
    found = F.array_position(F.array(*(F.lit(s) for s in starts)), F.col("key"))
    group = F.expr(f"cast(size(filter(array({','.join(f'{s}L' if s > -(2**63) else '-9223372036854775807L - 1L' for s in starts)}), s -> s <= key)) - 1 as int)")
    before = ((found - 2 + len(starts)) % len(starts)).cast("int")
    own = keyed.select(group.alias("group"), F.lit(0).alias("guest"), "doc_id", "text", "key", found.alias("found"), before.alias("before"))
    dealt = own.select(
        F.explode(F.when(F.col("found") > 0, F.array(F.struct("group", "guest"), F.struct(F.col("before").alias("group"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct("group", "guest")))).alias("at"), "doc_id", "text"
    ).select("at.group", "at.guest", "doc_id", "text")
    ordered = dealt.repartitionById(max(n, len(starts)), F.col("group")).sortWithinPartitions("group", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(lambda batches: row_batches(_pairs(batches), _OUT, 500), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_edited double")
