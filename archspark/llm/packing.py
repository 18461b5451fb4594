"""Sequence packing along a space-filling curve.

A document's token ids give a hashed vector, projected to DIMS dimensions and quantised; the Hilbert key of that cell
orders the documents. The order is cut into ranges of similar size, and each range is packed end to end into sequences of
LENGTH ids; what is left at the end of a range goes into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import kept_in_worker, mixed, partitions, row_batches, stored, texts

LENGTH, END = 2048, 1
DIMS, BITS = 4, 8
#: Runs whose ids a worker keeps; about 200 bytes each.
CACHED_RUNS = 400_000
#: Texts whose runs are told apart together.
TOGETHER = 750
#: ASCII marks but for the apostrophe, which may begin a word.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TOKENIZER = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts. No token of this tokenizer spans white space, so ids are cached by run of other bytes, and texts joined from them.

    Runs of letters are one word each to the tokenizer, so many are encoded as one text and told apart by the tokens that end
    a word; MARKS after letters are a word of their own.
    """

    JOINED = 200

    def __init__(self, path: str):
        self.tokenizer, self.cache = _tokenizer(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {}

    def encode(self, batch: list[bytes] | pa.Array) -> list[np.ndarray]:
        if len(self.cache) >= CACHED_RUNS:
            self.cache.clear()
        self.cache[b""] = b""
        texts = pa.array(batch, pa.large_binary()).cast(pa.large_string())
        # special tokens are looked up before lower-casing
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # splits at the bytes that bytes.split() splits at; leaves an empty run where a text begins or ends with one
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.values.dictionary_encode()  # each distinct run is looked up once
        distinct = coded.dictionary
        word = pc.ascii_rtrim(distinct, characters=MARKS)
        apart = pc.and_(pc.utf8_is_alpha(word), pc.equal(word, pc.utf8_lower(word)))
        word = pc.if_else(apart, word, distinct)
        words = word.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        of = list(map(self.cache.get, words))
        new = [k for k, ids in enumerate(of) if ids is None]
        self._add({words[k] for k in new})
        for k in new:
            of[k] = self.cache[words[k]]
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(word), pc.binary_length(distinct)).to_numpy(zero_copy_only=False))
        for k, run in zip(marked.tolist(), distinct.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist()):
            of[k] += self._mark(run[len(words[k].decode()) :])
        lengths = np.fromiter(map(len, of), np.int64, len(of)) // 4
        flat, first = np.frombuffer(b"".join(of), "<u4"), lengths.cumsum() - lengths
        places = coded.indices.to_numpy()
        n = lengths[places]
        stops = n.cumsum()
        ids = flat[np.repeat(first[places] - stops + n, n) + np.arange(n.sum())]
        return np.split(ids, np.r_[0, stops][runs.offsets.to_numpy()[1:-1]]) if len(runs) else []

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[mark] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
        return self.marks[mark]

    def _add(self, new: set[bytes]) -> None:
        cache, letters, other = self.cache, [], []
        for run in new:
            word = None if run.isalpha() and run.islower() else run.decode()  # None: of ASCII letters alone
            (letters if word is None or (word.isalpha() and word == word.lower()) else other).append(run)
        parts = [letters[i : i + self.JOINED] for i in range(0, len(letters), self.JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(part, stops):
                cache[word] = raw[at:stop]
                at = stop
        for word, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            cache[word] = array("I", e.ids).tobytes()


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(n, dims) cells in [0, 2^bits) -> position along the Hilbert curve of that grid."""
    x = [c.copy() for c in cells.astype(np.int64).T]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> level) & 1)
    return key


_PROJECTED = np.stack([mixed(np.arange(1 << 16, dtype=np.uint64) * np.uint64(DIMS) + np.uint64(d)) / 2**63 - 1 for d in range(DIMS)], axis=1)


def cell(ids: np.ndarray) -> list[int]:
    """The grid cell of a document: direction of its mean projected token vector, each coordinate made even by the normal distribution."""
    total = _PROJECTED[ids & 0xFFFF].sum(axis=0)
    unit = total / (np.linalg.norm(total) or 1.0) * math.sqrt(DIMS)
    return [min((1 << BITS) - 1, int((1 << BITS) * 0.5 * (1 + math.erf(v / math.sqrt(2))))) for v in unit]


_CODED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = kept_in_worker(f"encoder {path}", lambda: Encoder(path))  # tasks that follow each other share its cache
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            ids = encoder.encode(texts(part.column(1)))
            keys = hilbert_keys(np.array([cell(i) for i in ids]))
            raw = [i.astype("<u2" if not len(i) or i.max() < 1 << 16 else "<u4") for i in ids]
            # a leading byte tells the width of the ids
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([bytes([i.itemsize]) + i.tobytes() for i in raw], pa.binary())], schema=_CODED)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held: list[tuple[int, int, np.ndarray, int]] = []
    size, made = 0, TaskContext.get().partitionId() << 32

    def emit(length: int) -> Iterator[tuple]:
        """Take `length` ids from the front of what is held as one sequence."""
        nonlocal size, made
        offset = 0
        while offset < length:
            doc, start, ids, total = held.pop(0)
            if len(ids) > length - offset:
                held.insert(0, (doc, start + length - offset, ids[length - offset :], total))
                ids = ids[: length - offset]
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, made, offset
            offset += len(ids)
        size -= length
        made += 1

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(np.frombuffer(raw, f"<u{raw[0]}", offset=1), END)
            held.append((doc, 0, ids, len(ids)))
            size += len(ids)
            while size >= LENGTH:
                yield from emit(LENGTH)
    while size:
        yield from emit(1 << (size.bit_length() - 1))


def pack(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Each row of a repeated doc_id is packed. An empty table gives no rows.
    Equal keys are ordered, and cut between ranges, by doc_id, so copies never gather in one task.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    coded = stored(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _coded(b, path), "doc_id long, key long, ids binary"), "coded")
    ranged = coded.repartitionByRange(partitions(documents.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "ids")
    return ranged.mapInArrow(lambda b: row_batches(_packed(b), _PIECES), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
