"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles. Documents with equal sets form a class, whose smallest id stands for
it (a doc_id with several texts is in several classes, and links them). Class sketches have COORDINATES bins: in round i every shingle is thrown into one bin with a value in [i, i+1); a bin
keeps its smallest value; rounds go on until every bin has one, and from round COORDINATES on, round i aims at bin
i - COORDINATES, so all bins fill. Bands of ROWS coordinates are the buckets.

No table of all pairs of a bucket is made. First the smallest id of each bucket is paired with the others, the pairs are
verified on whole sets, and components are formed. Then, in buckets that still hold several components, the members outside
of the bucket's largest component meet all others: both kinds are dealt into blocks of about BLOCK members, and each two blocks
that have to meet are one task of at most about 2 * BLOCK. There the sketches are compared, and pairs that may be linked and
aren't connected yet are verified on whole sets. All pairs of one bucket are thus either tested or already connected. A bucket
of m members of which none is linked to the rest costs m * m / BLOCK rows: no family like it can be told apart beforehand
without losing links near the threshold.

Two linked documents share no band with probability 5e-6 at most, and agree in fewer than LEAST_AGREEING coordinates with 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import WordHashes, mixed, row_batches, seeds, shingle_set, stored, texts
from archspark.llm.components import components

COORDINATES, ROWS = 128, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of COORDINATES coordinates kept as bytes, all but a few linked pairs in a million agree in so many; pairs with less are not verified.
LEAST_AGREEING = 74
#: Members of a bucket that one block holds.
BLOCK = 512

_A, _B = seeds(2 * COORDINATES, 11), seeds(2 * COORDINATES, 13)


def fast_sketch(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: COORDINATES values, each comparable by equality. Rounds are taken in blocks; a later round can't lower a filled bin."""
    t = COORDINATES
    out = np.full(t, np.uint64(2**64 - 1))
    step = max(1, 4 * t // len(items))
    for start in range(0, 2 * t, step):
        rounds = np.arange(start, min(2 * t, start + step))
        thrown = mixed((items[None, :] * _A[rounds, None]) ^ _B[rounds, None])
        bins = np.where(rounds[:, None] < t, (thrown % np.uint64(t)).astype(np.int64), (rounds - t)[:, None])
        value = (thrown >> np.uint64(9)) | (rounds.astype(np.uint64)[:, None] << np.uint64(55))
        np.minimum.at(out, bins.ravel(), value.ravel())
        if out.max() >> np.uint64(55) < start + len(rounds):
            break
    return mixed(out)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band, different between bands."""
    by_band = sketch.reshape(-1, ROWS)
    total = (by_band * seeds(ROWS, 17)).sum(axis=1, dtype=np.uint64) + np.arange(len(by_band), dtype=np.uint64)
    return mixed(total).view(np.int64)


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()

    def rows():
        for batch in batches:
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                s = shingle_set(text, cache)
                if not len(s):
                    yield doc, text_hash, 0, None, [], b""
                    continue
                sig = int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))
                # sets of one or two shingles reach three quarters with equal sets only
                bins = fast_sketch(s) if len(s) > 2 else None
                yield doc, text_hash, len(s), sig, band_keys(bins).tolist() if bins is not None else [], (bins >> np.uint64(56)).astype(np.uint8).tobytes() if bins is not None else b""

    return row_batches(rows(), _SKETCHED)


def _linked(s: np.ndarray, r: np.ndarray) -> bool:
    both = len(np.intersect1d(s, r, assume_unique=True))
    return 100 * both >= PERCENT * (len(s) + len(r) - both) > 0


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of classes (a, b, a_doc, b_doc) whose sizes and sketches allow a link."""
    side = lambda p: nodes.select(F.col("sig").alias(p), F.col("n").alias(f"n_{p}"), F.col("sketch").alias(f"sketch_{p}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (4, 5))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (6, 7))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(((a == b).sum(axis=1) >= LEAST_AGREEING) & _fits(n, m)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_doc", "b_doc", "n_a", "n_b", "sketch_a", "sketch_b")
    return both.mapInArrow(kept, "a long, b long, a_doc long, b_doc long")


def _verified(pairs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """(a, b): the doc_ids of the pairs whose whole sets reach the similarity; texts go to the pairs, sets are made again in the task."""
    side = lambda p: texts_of.select(F.col("sig").alias(p), F.col("text").alias(f"text_{p}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sets = WordHashes(), {}

        def of(sig: int, text: bytes) -> np.ndarray:
            if sig not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[sig] = shingle_set(text, cache)
            return sets[sig]

        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            mask = [_linked(of(a, x), of(b, y)) for a, b, x, y in zip(*ids, texts(batch.column(4)), texts(batch.column(5)))]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mask, pa.bool_())).columns[2:4], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_doc", "b_doc", "text_a", "text_b")
    return both.mapInArrow(kept, "a long, b long")


_BLOCK = "key long, block int, other int, sigs array<long>, docs array<long>, a array<int>, b array<int>, component array<long>"
_BLOCK_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("other", pa.int32()), ("sigs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("component", pa.list_(pa.int64()))])
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(rows: pa.Table) -> pa.Table:
    """Two blocks of a bucket, or one with itself: the pairs of a member outside of the largest component and another, of different components, that may be linked and have this bucket as their first; most alike first."""
    sig, doc, component, n, band, own = (rows.column(c).to_numpy() for c in ("sig", "doc_id", "component", "n", "band", "own"))
    block, other = (rows.column(c)[0].as_py() for c in ("block", "other"))
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bands = np.array(rows.column("bands").to_pylist(), np.int64).reshape(len(doc), -1)
    right = np.flatnonzero(own == other)
    found: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(own == block):
        with_ = right[(component[right] != component[i]) & _fits(n[right], n[i])]
        if block == other:
            with_ = with_[sig[with_] > sig[i]]
        alike = (sketches[with_] == sketches[i]).sum(axis=1)
        with_, alike = with_[alike >= LEAST_AGREEING], alike[alike >= LEAST_AGREEING]
        first = (bands[with_] == bands[i]).argmax(axis=1) == band[i]
        found += [(-int(x), int(i), int(j)) for x, j in zip(alike[first], with_[first])]
    if not found:
        return _BLOCK_ARROW.empty_table()
    found.sort()
    used, place = np.unique([(i, j) for _, i, j in found], return_inverse=True)
    place = place.reshape(-1, 2)
    values = (rows.column("key")[0].as_py(), block, other, sig[used].tolist(), doc[used].tolist(), place[:, 0].tolist(), place[:, 1].tolist(), component[used].tolist())
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_ARROW)], schema=_BLOCK_ARROW)


def _block_links(block: pa.Table, docs: pa.Table) -> pa.Table:
    """Verify the candidates of a block on whole sets; those that links already connect are passed over."""
    links: list[tuple[int, int]] = []
    if block.num_rows:
        own, cache = block.to_pylist()[0], WordHashes()
        sets = {d: shingle_set(t, cache) for d, t in zip(docs.column("sig").to_pylist(), texts(docs.column("text")))}
        root = {c: c for c in own["component"]}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in zip(own["a"], own["b"]):
            x, y = top(own["component"][i]), top(own["component"][j])
            if x != y and _linked(sets[own["sigs"][i]], sets[own["sigs"][j]]):
                root[max(x, y)] = min(x, y)
                links.append((own["docs"][i], own["docs"][j]))
    return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_LINK_ARROW)


def _open_links(multi: DataFrame, comp: DataFrame, nodes: DataFrame, texts_of: DataFrame) -> DataFrame:
    """Links between members of one bucket that are in different components so far."""
    placed = multi.join(comp, multi["doc_id"] == comp["id"], "left").select("key", "band", "sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    by_component = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    split = by_component.groupBy("key").agg(F.max(F.struct("size", F.col("component").alias("c"))).alias("largest"), F.sum("size").alias("total"), F.count("*").alias("parts"))
    many = lambda members: F.ceil(members / BLOCK).cast("int")
    split = split.where("parts > 1").select("key", F.col("largest.c").alias("major"), many(F.col("total") - F.col("largest.size")).alias("n_minor"), many(F.col("largest.size")).alias("n_major"))
    minor = F.col("component") != F.col("major")
    # blocks of minors have the numbers 0, 1, .., those of the largest component -1, -2, ..
    own = F.when(minor, F.pmod(F.xxhash64("sig"), F.col("n_minor"))).otherwise(-1 - F.pmod(F.xxhash64("sig"), F.col("n_major"))).cast("int")
    dealt = placed.join(split, "key").select("key", "band", "sig", "doc_id", "component", "n_minor", "n_major", minor.alias("minor"), own.alias("own"))
    with_minors = F.transform(F.sequence(F.lit(0), F.col("n_minor") - 1), lambda j: F.when(F.col("own") < 0, F.struct(j.alias("block"), F.col("own").alias("other"))).otherwise(F.struct(F.least("own", j).alias("block"), F.greatest("own", j).alias("other"))))
    with_majors = F.transform(F.sequence(F.lit(-1), -F.col("n_major"), F.lit(-1)), lambda j: F.struct(F.col("own").alias("block"), j.alias("other")))
    tasks = F.when(F.col("minor"), F.concat(with_minors, with_majors)).otherwise(with_minors)
    dealt = dealt.select("key", "band", "sig", "doc_id", "component", "own", F.explode(tasks).alias("task")).select("key", "task.block", "task.other", "band", "sig", "doc_id", "component", "own")
    dealt = dealt.join(nodes, "sig").select("key", "block", "other", "band", "sig", "doc_id", "component", "own", "n", "sketch", "bands")
    found = stored(dealt.groupBy("key", "block", "other").applyInArrow(_candidates, _BLOCK), "blocks")
    wanted = found.select(F.col("key").alias("w_key"), F.col("block").alias("w_block"), F.col("other").alias("w_other"), F.explode("sigs").alias("sig")).join(texts_of, "sig").select("w_key", "w_block", "w_other", "sig", "text")
    return found.groupBy("key", "block", "other").cogroup(wanted.groupBy("w_key", "w_block", "w_other")).applyInArrow(_block_links, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept, class_id.

    Null and empty texts have no set and link with nothing. Repeated rows come back each; a doc_id with several texts links as
    all of them, each verified on its own set. A row without doc_id comes back unlinked, with null component_id, and is kept.
    An empty table gives no rows.
    """
    documents = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    rows = stored(documents.mapInArrow(_sketched, "doc_id long, text_hash long, n_shingles long, sig long, bands array<long>, sketch binary"), "sketches")
    own = rows.where("sig is not null and doc_id is not null")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    classes = stored(own.groupBy("sig").agg(one, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("sig", "one.doc_id", "one.text_hash", "n", "bands", "sketch"), "classes")
    tied = own.select("doc_id", "sig").join(classes.select("sig", F.col("doc_id").alias("of")), "sig").select("doc_id", "of")
    placed_in = stored(tied.groupBy("doc_id").agg(F.min("of").alias("class_id"), F.max("of").alias("last")), "placed")
    several = placed_in.where("class_id < last").select("doc_id", "class_id")  # a doc_id with several texts is in the classes of them all
    across = tied.join(several, "doc_id").where("of != class_id").select(F.col("class_id").alias("a"), F.col("of").alias("b")).distinct()

    members = classes.select("sig", "doc_id", F.posexplode("bands").alias("band", "key"))
    least = members.groupBy("key").agg(F.min(F.struct("doc_id", "sig")).alias("centre"), F.max(F.struct("doc_id", "sig")).alias("last")).where("centre < last").select("key", "centre")
    multi = stored(members.join(least, "key").select("key", F.col("band").cast("short").alias("band"), "sig", "doc_id", "centre"), "members")
    needed = multi.select("sig").distinct()
    nodes = stored(classes.join(needed, "sig", "left_semi").select("sig", "doc_id", "text_hash", "n", "sketch", "bands"), "nodes")
    texts_of = stored(documents.join(nodes.select("doc_id", "text_hash", "sig"), ["doc_id", "text_hash"]).groupBy("sig").agg(F.min("text").alias("text")), "texts")
    nodes = nodes.select("sig", "n", "sketch", "bands")

    pairs = multi.where("sig != centre.sig").select(F.col("centre.sig").alias("a"), F.col("sig").alias("b"), F.col("centre.doc_id").alias("a_doc"), F.col("doc_id").alias("b_doc")).distinct()
    links = stored(_verified(stored(_likely(pairs, nodes), "likely"), texts_of), "links")
    comp = stored(components(links.union(across)), "components")
    more = stored(_open_links(multi.select("key", "band", "sig", "doc_id"), comp, nodes, texts_of).distinct(), "more")

    def placed(links: DataFrame, of: DataFrame) -> DataFrame:
        """Component of both ends of the links."""
        for p in "ab":
            links = links.join(of.select(F.col("id").alias(p), F.col("component").alias(f"c_{p}")), p, "left").withColumn(p, F.coalesce(f"c_{p}", p)).drop(f"c_{p}")
        return links.select("a", "b")

    final = comp
    if not more.isEmpty():
        joined = components(placed(more, comp)).select(F.col("id").alias("old"), F.col("component").alias("new"))
        every = comp.union(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("component")))
        final = stored(every.join(joined, every["component"] == joined["old"], "left").select("id", F.coalesce("new", "component").alias("component")), "components")
    placing = placed_in.join(final, placed_in["class_id"] == final["id"], "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(placing, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
