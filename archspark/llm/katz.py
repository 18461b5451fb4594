"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are read once and stored as batches of word numbers with a dictionary of word hashes, bucketed by batch. A batch asks
for the counts of its distinct n-grams: one compressed request per bucket of the hashed key, and one answer back. So a
frequent n-gram is one entry per batch, however often it occurs, and nothing about the corpus is broadcast but a dozen
totals. A history that follows very many tokens is spread over several buckets by the following word; its sums are added up
by the batch that asked. Scores are then evaluated per token: the discounted bigram where it was seen, else the history's
backoff weight and the discounted unigram, and for words not in training the mass that the unigram discounts left.

P(w | h) = d(c(hw)) c(hw) / c(h) where c(hw) > 0, else alpha(h) P(w);  P(w) = d(c(w)) c(w) / N, and what is left for all
unknown words together. alpha(h) = (what the discounts of h leave) / (1 - sum of P(w) over the seen followers of h). A history
none of whose counts is discounted has c(h) + 1 for its denominator, so that some mass is left.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import WordHashes, bucketed, hashed, mixed, partitions, row_batches, stored, words_of

#: Counts above this one are not discounted.
K = 5
#: Bytes of text after which a batch ends, and requested entries for one bucket.
BATCH_BYTES, BUCKET_ENTRIES = 12 << 20, 4_000_000

#: Hashes of what can't be a word, as words hold no space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b" end", b" start"))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: unsigned integers in the smallest type, bytes of equal rank together, compressed."""
    out, press = [], zstandard.ZstdCompressor(level=1)
    for a in arrays:
        if a.dtype != np.float64:
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        raw = press.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        out += [struct.pack("<cQQ", a.dtype.char.encode(), len(a), len(raw)), raw]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at, press = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        kind, n, size = struct.unpack_from("<cQQ", blob, at)
        at += 17
        planes = np.frombuffer(press.decompress(blob[at : at + size], max_output_size=max(1, n * np.dtype(kind.decode()).itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(-1, n).T).view(kind.decode()).ravel() if n else np.empty(0, kind.decode()))
        at += size
    return out


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r = 0 .. K + 1 from counts of counts n[1] .. n[K + 1] (n[0] is ignored); d[0] is 0, d[K + 1] holds above K.

    Good-Turing on smoothed counts of counts: ln n[r] is fitted by a line in ln r (those of 0 left out), so that
    r* / r = (1 + 1/r) ** (slope + 1), renormalised so that counts above K keep theirs. A slope below -1 gives values between
    0 and 1 always, however uneven the counts of counts are. Where no such line exists (fewer than two kinds of counts, or
    counts of counts that don't fall that fast, as in tiny corpora), one absolute discount takes its place.
    """
    d = np.ones(K + 2)
    d[0] = 0
    r = np.array([r for r in range(1, K + 2) if n[r] > 0])
    slope = np.polyfit(np.log(r), np.log([n[x] for x in r]), 1)[0] if len(r) > 1 else 0.0
    if slope < -1:
        ratio = (1 + 1 / np.arange(1, K + 1)) ** (slope + 1)
        rest = (K + 1.0) ** (slope + 1)
        d[1 : K + 1] = (ratio - rest) / (1 - rest)
        return d
    less = min(0.9, n[1] / (n[1] + 2 * n[2])) if n[1] else 0.5
    d[1 : K + 1] = [(x - less) / x for x in range(1, K + 1)]
    return d


class Unigrams:
    """Discounted unigram probabilities as a function of the count, from N, V and counts of counts."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.below = total if left > 0 else total + 1
        self.unknown = left / total if left > 0 else 1 / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d[np.minimum(counts, K + 1)] * counts / max(self.below, 1), self.unknown)


_CODED = "batch long, docs array<long>, held array<boolean>, n_tokens long, train_docs long, dict binary, train binary, seq binary"
_CODED_ARROW = pa.schema([("batch", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.int64()), ("train_docs", pa.int64()), ("dict", pa.binary()), ("train", pa.binary()), ("seq", pa.binary())])
_REQUEST = "bucket int, batch long, request binary"
_REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("request", pa.binary())])
#: An answer has a batch, the totals of a bucket have none.
_ANSWER = "batch long, bucket int, answer binary, totals array<long>"
_ANSWER_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), ("totals", pa.list_(pa.int64()))])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    docs, held, words, size, made = [], [], [], 0, TaskContext.get().partitionId() << 24

    def row() -> pa.RecordBatch:
        lens = np.array([len(w) for w in words])
        known, seq = np.unique(np.concatenate(words), return_inverse=True)
        training = np.repeat(~np.array(held), lens)
        train = np.bincount(seq[training], minlength=len(known))
        values = [made, docs, held, len(seq), len(held) - sum(held), packed(known), packed(train), packed(lens, seq)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CODED_ARROW)], schema=_CODED_ARROW)

    for batch in batches:
        for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            text = text.as_py() or b""
            docs.append(doc)
            held.append(out)
            words.append(np.append(hashed(words_of(text), cache), END))
            size += len(text) + 8
            if size >= BATCH_BYTES:
                yield row()
                docs, held, words, size, made = [], [], [], 0, made + 1
    if docs:
        yield row()


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The n ranges of equal width of the 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(ordered: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    cuts = np.searchsorted(ordered, np.arange(n + 1))
    return ((b, int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)))


def _ask_words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    for batch in batches:
        for at, known, train in zip(*(batch.column(i).to_pylist() for i in range(3))):
            (known,), (train,) = unpacked(known), unpacked(train)
            for b, i, j in _slices(_bucket(known, n), n):
                yield int(b), at, packed(known[i:j], train[i:j])


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2].tolist()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, list[np.ndarray]]]:
    return [(b, at, unpacked(r)) for batch in batches for b, at, r in zip(*(batch.column(i).to_pylist() for i in range(3)))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One bucket: total training counts of its words, back to each batch that asked."""
    rows = _rows_of(batches)
    if not rows:
        return
    keys, place = np.unique(np.concatenate([r[0] for _, _, r in rows]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([r[1] for _, _, r in rows]), len(keys)).astype(np.int64)
    at = 0
    for b, batch, r in rows:
        yield batch, b, packed(counts[place[at : at + len(r[0])]]), None
        at += len(r[0])
    yield None, rows[0][0], packed(keys, counts), [int(counts.sum()), int((counts > 0).sum()), *_counts_of_counts(counts)]


class _Batch:
    """A coded batch with the training counts of its words, and its distinct (history, word) pairs."""

    def __init__(self, coded: dict, answers: pa.Table, words: Unigrams, train_docs: int):
        (self.known,) = unpacked(coded["dict"])
        self.lens, self.seq = unpacked(coded["seq"])
        self.lens, self.seq, self.held = self.lens.astype(np.int64), self.seq.astype(np.int64), np.array(coded["held"])
        first = answers.column("bucket").to_pylist()
        blobs = answers.column("answer").to_pylist()
        self.counts = np.concatenate([unpacked(blobs[i])[0] for i in np.argsort(first)]).astype(np.int64)
        self.p = words(self.counts)
        n = len(self.known)
        self.ends = self.lens.cumsum()
        history = np.empty_like(self.seq)
        history[1:] = self.seq[:-1]
        history[self.ends - self.lens] = n
        code, self.pair = np.unique(history * (n + 1) + self.seq, return_inverse=True)
        self.trained = np.bincount(self.pair[np.repeat(~self.held, self.lens)], minlength=len(code))
        self.h, self.w = code // (n + 1), code % (n + 1)
        self.h_hash, self.h_count = np.append(self.known, START), np.append(self.counts, train_docs)

    def groups(self, n: int, total: int) -> None:
        """Deal the pairs into n buckets by history, and a history of many tokens by word too. A group is a history in one bucket."""
        self.hs, h_at = np.unique(self.h, return_inverse=True)
        count = self.h_count[self.hs]
        spread = np.minimum(n, 1 + 4 * n * count // max(total, 1))
        base = np.concatenate([[0], spread.cumsum()])
        self.g_h = np.repeat(np.arange(len(self.hs)), spread)
        sub = np.arange(base[-1]) - base[self.g_h]
        self.g_spread = spread[self.g_h] > 1
        g_bucket = (_bucket(mixed(self.h_hash[self.hs]), n)[self.g_h] + sub) % n
        order = np.argsort(g_bucket, kind="stable")
        self.g_h, self.g_spread, self.g_bucket = self.g_h[order], self.g_spread[order], g_bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        g = rank[base[h_at] + (mixed(self.known)[self.w] % spread[h_at].astype(np.uint64)).astype(np.int64)]
        self.order = np.argsort(g, kind="stable")
        self.g_size = np.bincount(g, minlength=len(order))
        self.g_end = self.g_size.cumsum()

    def requests(self, n: int) -> Iterator[tuple[int, bytes]]:
        for b, i, j in _slices(self.g_bucket, n):
            own = self.order[self.g_end[i] - self.g_size[i] : self.g_end[j - 1]]
            ws, place = np.unique(self.w[own], return_inverse=True)
            yield int(b), packed(self.h_hash[self.hs[self.g_h[i:j]]], self.g_spread[i:j].astype(np.uint8), self.g_size[i:j], self.known[ws] >> np.uint64(24), self.counts[ws], place, self.trained[own])


def _count_pairs(batches: Iterator[pa.RecordBatch], words: Unigrams) -> Iterator[tuple]:
    """One bucket: counts of its pairs, and for histories that need them the sums for their backoff weight, back to each batch that asked."""
    rows = _rows_of(batches)
    if not rows:
        return
    all_h, place_h = np.unique(np.concatenate([r[0] for _, _, r in rows]), return_inverse=True)
    sizes = np.concatenate([r[2] for _, _, r in rows]).astype(np.int64)
    h = np.repeat(place_h, sizes)
    keys = mixed(all_h[h] * np.uint64(3) + np.concatenate([r[3][r[5]] for _, _, r in rows]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([r[6] for _, _, r in rows]), len(keys)).astype(np.int64)
    seen = counts > 0
    k_h, p = h[first], words(np.concatenate([r[4][r[5]] for _, _, r in rows]).astype(np.int64)[first])
    followers = np.bincount(k_h[seen], p[seen], len(all_h))
    low = [np.bincount(k_h[counts == r], minlength=len(all_h)) for r in range(1, K + 1)]
    whole = sum(low) == 0
    n_groups, own = 0, counts[place]
    unseen = np.bincount(np.repeat(np.arange(len(sizes)), sizes), own == 0, len(sizes)) > 0
    at = 0
    for b, batch, r in rows:
        hs = place_h[n_groups : n_groups + len(r[0])]
        needs = unseen[n_groups : n_groups + len(r[0])] | whole[hs] | (r[1] > 0)
        yield batch, b, packed(own[at : at + len(r[5])], needs.astype(np.uint8), *(m[hs[needs]] for m in low), followers[hs[needs]]), None
        n_groups, at = n_groups + len(r[0]), at + len(r[5])
    yield None, rows[0][0], None, [int(counts.sum()), int(seen.sum()), *_counts_of_counts(counts)]


def _score(part: _Batch, docs: list, answers: pa.Table, n: int, words: Unigrams, total: int, d: np.ndarray) -> pa.Table:
    part.groups(n, total)
    by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()))
    counts, left, followers = np.zeros(len(part.h), np.int64), np.zeros(len(part.hs)), np.zeros(len(part.hs))
    answered = np.zeros(len(part.hs), bool)
    for b, i, j in _slices(part.g_bucket, n):
        own, needs, *sums = unpacked(by_bucket[int(b)])
        counts[part.order[part.g_end[i] - part.g_size[i] : part.g_end[j - 1]]] = own
        hs = part.g_h[i:j][needs > 0]
        left[hs] += sum((1 - d[r]) * r * sums[r - 1].astype(float) for r in range(1, K + 1))
        followers[hs] += sums[K]
        answered[hs] = True
    h_at = np.searchsorted(part.hs, part.h)
    below = part.h_count[part.hs].astype(float)
    kept_whole = answered & (left <= 0)
    left[kept_whole], below[kept_whole] = 1, below[kept_whole] + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = np.where(part.h_count[part.hs] > 0, np.log10(left / below / (1 - followers)), 0.0)[h_at]
        log_pair = np.where(counts > 0, np.log10(d[np.minimum(counts, K + 1)] * counts / below[h_at]), backoff + np.log10(part.p)[part.w])
    starts = part.ends - part.lens
    base = np.log10((part.counts + 0.5) / (total + 0.5 * (words.distinct + 1)))
    return pa.Table.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(part.held), pa.array(part.lens), pa.array(np.add.reduceat((part.counts > 0).astype(np.int64)[part.seq], starts)), pa.array(np.full(len(docs), total)), pa.array(np.add.reduceat(base[part.seq], starts)), pa.array(np.add.reduceat(log_pair[part.pair], starts))],
        schema=_SCORES_ARROW,
    )


def _totals(answers: DataFrame) -> list[int]:
    return list(answers.where("batch is null").select(*(F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)).alias(f"t{i}") for i in range(K + 4))).first())


def katz_scores(documents: DataFrame, held_out: str) -> DataFrame:
    """documents(doc_id, text) and a boolean SQL expression -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where `held_out` is not true train the model; all rows are scored, in base-10 logarithms. A null or empty text is its
    end alone. Repeated rows count and come back each; an empty table gives no rows; without training rows every word is
    unknown and has probability 1.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"))
    # each task's rows go to a few buckets by their batch number, so no shuffle is needed to write them, or to meet answers by batch later
    coded = bucketed(source.mapInArrow(_coded, _CODED), "coded", "batch")
    tokens, train_docs = (int(x or 0) for x in coded.agg(F.sum("n_tokens"), F.sum("train_docs")).first())
    if not tokens:
        return spark.createDataFrame([], _SCORES)
    buckets = max(n, -(-tokens // BUCKET_ENTRIES))

    def answered(requests: DataFrame, count, what: str) -> DataFrame:
        dealt = requests.repartitionById(buckets, F.col("bucket"))
        return stored(dealt.mapInArrow(lambda b: row_batches(count(b), _ANSWER_ARROW, 4), _ANSWER), what)

    asked = coded.select("batch", "dict", "train").mapInArrow(lambda b: row_batches(_ask_words(b, buckets), _REQUEST_ARROW, 16), _REQUEST)
    of_words = answered(asked, _count_words, "unigrams")
    total, distinct, *n_words = _totals(of_words)
    words = Unigrams(total, distinct, n_words)
    by_batch = of_words.where("batch is not null").select("batch", "bucket", "answer").groupBy("batch")

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Batch(left.to_pylist()[0], right, words, train_docs)
        part.groups(buckets, total)
        rows = [(b, left.column("batch")[0].as_py(), blob) for b, blob in part.requests(buckets)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REQUEST_ARROW)], schema=_REQUEST_ARROW)

    asked = coded.select("batch", "held", "dict", "seq").groupBy("batch").cogroup(by_batch).applyInArrow(ask_pairs, _REQUEST)
    of_pairs = answered(asked, lambda b: _count_pairs(b, words), "bigrams")
    d = discounts(_totals(of_pairs)[2:])
    both = of_words.select("batch", F.lit(1).alias("n"), "bucket", "answer").union(of_pairs.select("batch", F.lit(2), "bucket", "answer")).where("batch is not null").groupBy("batch")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.to_pylist()[0]
        order = right.column("n").to_numpy()
        part = _Batch(own, right.filter(pa.array(order == 1)), words, train_docs)
        return _score(part, own["docs"], right.filter(pa.array(order == 2)), buckets, words, total, d)

    return coded.select("batch", "docs", "held", "dict", "seq").groupBy("batch").cogroup(both).applyInArrow(score, _SCORES)
