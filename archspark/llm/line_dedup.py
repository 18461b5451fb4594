"""Substring dedup by hashing: the earliest occurrence of a unit stays, later ones go, with offsets into the original text.

A unit starts at a line and has as few lines as give it LEAST_WORDS words: mostly one line, or a run of short ones, so that a
passage of several short lines is found wherever it stands. `repeated_passages` adds runs of RUN words wherever they begin,
chosen by winnowing: of every PASSAGE words in a row, the run of the least hash is a unit, so a passage of PASSAGE words or more
that repeats has a unit in common with its first occurrence. Units that overlap in both texts are joined, and what they give
is extended word by word, by PASSAGE - RUN words at either end, as far as both texts agree: so the whole repeated passage is
found. Units are compared by a 128-bit digest of their normal form, words beyond them by a 64-bit one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.llm.common import CACHE_WORDS, WordHashes, row_batches, seeds, shingles, stored

#: Units of fewer words are too short to count as repeated passages.
LEAST_WORDS = 20
#: A repeat of PASSAGE words is found wherever it stands, by a run of RUN of its words.
PASSAGE, RUN = 50, 26

_OUT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_words", pa.int64())])
_COLUMNS = "h1 long, h2 long, doc_id long, text_hash long, start long, length long, n_words long"
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"(\W+)")
_SECOND = seeds(RUN, 31)


def normalised(line: str) -> list[str]:
    """The words of a line without case, punctuation and spacing."""
    return _WORD.findall(line.lower())


def spans(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, list[str]]]:
    """Start, length and words of the units of a text; lines without a word start no unit, and none ends one."""
    lines: list[tuple[int, int, list[str]]] = []
    start = 0
    for line in text.split("\n"):
        if words := normalised(line):
            lines.append((start, start + len(line), words))
        start += len(line) + 1
    last = total = 0
    for i, (start, _, words) in enumerate(lines):
        while last < len(lines) and total < least_words:
            total += len(lines[last][2])
            last += 1
        if total < least_words:
            return
        yield start, lines[last - 1][1] - start, [w for _, _, ws in lines[i:last] for w in ws]
        total -= len(words)


class _Normal(WordHashes):
    """word -> hash of its normal form."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


def _words(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a text with their starts and ends."""
    pieces = _GAP.split(text)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = lengths.cumsum()[::2]
    words = pieces[::2]
    some = slice(not words[0], len(words) - (not words[-1]))
    return words[some], (ends - lengths[::2])[some], ends[some]


def runs(text: str, cache: _Normal) -> Iterator[tuple[int, int, int, int]]:
    """Digest (two halves), start and length of the winnowed runs of RUN words of a text; none where it has fewer than PASSAGE words."""
    words, starts, ends = _words(text)
    if len(words) < PASSAGE:
        return
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    first = shingles(hashes, RUN)
    width = PASSAGE - RUN + 1
    back = np.lib.stride_tricks.sliding_window_view(first, width)[:, ::-1].argmin(axis=1)
    least = np.arange(width - 1, width - 1 + len(back)) - back  # the last least hash of each window; never falls
    at = least[np.r_[True, least[1:] != least[:-1]]]
    second = (hashes[at[:, None] + np.arange(RUN)] * _SECOND).sum(axis=1, dtype=np.uint64)
    yield from zip(first[at].view(np.int64).tolist(), second.view(np.int64).tolist(), starts[at].tolist(), (ends[at + RUN - 1] - starts[at]).tolist())


def units(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit of lines: 128-bit digest of its normal form, doc_id and hash of the text, start and length in code points, n_words."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for doc, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
                for start, length, words in spans(text or "", least_words):
                    yield *_digest(words), doc, text_hash, start, length, len(words)

    return _keyed(documents).mapInArrow(lambda b: row_batches(rows(b), _OUT, 10_000), _COLUMNS)


def _all_units(documents: DataFrame, least_words: int) -> DataFrame:
    """As `units`, and the winnowed runs, which have 0 for n_words."""

    def rows(batches: Iterator[pa.RecordBatch]):
        cache = _Normal()
        for batch in batches:
            for doc, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
                for start, length, words in spans(text or "", least_words):
                    yield *_digest(words), doc, text_hash, start, length, len(words)
                for h1, h2, start, length in runs(text or "", cache):
                    yield h1, h2, doc, text_hash, start, length, 0

    return _keyed(documents).mapInArrow(lambda b: row_batches(rows(b), _OUT, 10_000), _COLUMNS)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash("text").alias("text_hash"))


def _digest(words: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _firsts(every: DataFrame) -> DataFrame:
    """The first place of each digest that occurs more than once."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "start", "text_hash", "length")
    return every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")


def _repeated(every: DataFrame, firsts: DataFrame) -> DataFrame:
    """The units that an earlier one equals."""
    at_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = every.join(firsts, ["h1", "h2"]).where(~at_first)
    return later.select("doc_id", "text_hash", "start", "length", "n_words", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "text_hash", "start", "length")))


def repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """documents(doc_id, text) -> a row per unit of lines to remove: doc_id, start, length, n_words, first_doc_id, first_start.

    The occurrence of the smallest (doc_id, start) stays; null doc_ids come last. Null, empty and short texts have no units;
    of rows with one doc_id and one text, all count as the same place. An empty table gives no rows. Spans may overlap.
    """
    every = units(documents, least_words)
    return _repeated(every, _firsts(every)).select("doc_id", "start", "length", "n_words", "first_doc_id", "first_start")


def repeated_passages(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """documents(doc_id, text) -> the rows of `repeated_lines` and a row per repeated passage wherever it stands, with text_hash, which tells rows of one doc_id apart.

    Spans may overlap. A passage that repeats within one text is taken from behind its first occurrence on.
    """
    every = stored(_all_units(documents, least_words), "units")
    later = stored(_repeated(every, stored(_firsts(every), "firsts")), "later")  # stored, so that a join skewed by a frequent passage can be split
    columns = ["doc_id", "text_hash", "start", "length", "n_words", "first_doc_id", "first_start"]
    return later.where("n_words > 0").select(*columns).unionByName(_extended(documents, _joined(later.where("n_words = 0"))).select(*columns))


def _joined(later: DataFrame) -> DataFrame:
    """Runs of one text that overlap, and whose first occurrences in one text overlap too, as one: doc_id, text_hash, start, stop and first_*."""
    pair = ["doc_id", "text_hash", "first_doc_id", "first_text_hash"]
    by = Window.partitionBy(*pair).orderBy("start", "first_start")
    placed = later.select(*pair, "start", "first_start", (F.col("start") + F.col("length")).alias("stop"), (F.col("first_start") + F.col("first_length")).alias("first_stop"))
    new = F.coalesce((F.col("start") > F.lag("stop").over(by)) | (F.col("first_start") > F.lag("first_stop").over(by)) | (F.col("first_start") < F.lag("first_start").over(by)), F.lit(True))
    part = placed.withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*pair, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_start").alias("first_start"), F.max("first_stop").alias("first_stop")).drop("part")


class _Placed:
    """A text's words, to look beyond a span: hashes of the words before its start and after its stop, nearest first."""

    def __init__(self, text: str, cache: _Normal):
        words, self.starts, self.stops = _words(text)
        self.hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def before(self, start: int) -> np.ndarray:
        i = int(np.searchsorted(self.starts, start))
        return self.hashes[max(0, i - PASSAGE + RUN) : i][::-1]

    def after(self, stop: int) -> np.ndarray:
        i = int(np.searchsorted(self.stops, stop)) + 1
        return self.hashes[i : i + PASSAGE - RUN]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    return n if same.all() else int(same.argmin())


_BEYOND = pa.schema([("at_doc", pa.int64()), ("at_hash", pa.int64()), ("side", pa.int32()), ("at", pa.int64()), ("beyond", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("first_start", pa.int64())])


def _extended(documents: DataFrame, joined: DataFrame) -> DataFrame:
    """Spans with as many words at either end as agree with the first occurrence.

    First the words beyond the first occurrences are taken from their texts, then they meet the texts of the others. What is
    gathered for a text are places in it, so never more than it has runs.
    """
    docs = _keyed(documents).where("text is not null")

    def beyond(batches: Iterator[pa.RecordBatch]):
        cache = _Normal()
        for batch in batches:
            for doc, text_hash, text, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
                placed = _Placed(text, cache)
                for at in starts:
                    yield doc, text_hash, 0, at, placed.before(at).tobytes()
                for at in stops:
                    yield doc, text_hash, 1, at, placed.after(at).tobytes()

    firsts = joined.groupBy(F.col("first_doc_id").alias("of"), F.col("first_text_hash").alias("of_hash")).agg(F.collect_set("first_start").alias("starts"), F.collect_set("first_stop").alias("stops"))
    at = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).select("doc_id", "text_hash", "text", "starts", "stops")
    words = stored(at.mapInArrow(lambda b: row_batches(beyond(b), _BEYOND), "at_doc long, at_hash long, side int, at long, beyond binary").distinct(), "beyond")
    for side, place, name in ((0, "first_start", "before"), (1, "first_stop", "after")):
        own = words.where(F.col("side") == side).drop("side").withColumnRenamed("beyond", name)
        joined = joined.join(own, F.col("first_doc_id").eqNullSafe(F.col("at_doc")) & (F.col("first_text_hash") == F.col("at_hash")) & (F.col(place) == F.col("at"))).drop("at_doc", "at_hash", "at")
    same_text = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_hash") == F.col("first_text_hash"))
    span = F.struct("start", "stop", "first_doc_id", "first_start", F.when(same_text, F.col("first_stop")).otherwise(0).alias("least"), "before", "after")
    by_doc = joined.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).agg(F.collect_list(span).alias("spans"))

    def extended(batches: Iterator[pa.RecordBatch]):
        cache = _Normal()
        for batch in batches:
            for doc, text_hash, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                placed = _Placed(text, cache)
                for x in found:
                    before, after = (np.frombuffer(x[c], np.uint64) for c in ("before", "after"))
                    i = int(np.searchsorted(placed.starts, x["start"])) - _agreeing(placed.before(x["start"]), before)
                    i = max(i, int(np.searchsorted(placed.starts, x["least"])))
                    j = int(np.searchsorted(placed.stops, x["stop"])) + _agreeing(placed.after(x["stop"]), after)
                    if i <= j:
                        start = int(placed.starts[i])
                        yield doc, text_hash, start, int(placed.stops[j]) - start, j - i + 1, x["first_doc_id"], x["first_start"]

    both = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).select("doc_id", "text_hash", "text", "spans")
    return both.mapInArrow(lambda b: row_batches(extended(b), _SPANS), "doc_id long, text_hash long, start long, length long, n_words long, first_doc_id long, first_start long").distinct()  # repeated rows


def cut(text: str, gone: list[dict]) -> str:
    """A text without spans, which may overlap, and without the line end or other white space after each."""
    out, at = [], 0
    for span in sorted(gone, key=lambda g: g["start"]):
        out.append(text[at : max(at, span["start"])])
        end = span["start"] + span["length"]
        at = max(at, end + text[end : end + 1].isspace())
    return "".join([*out, text[at:]])


def without_lines(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without the given spans (and their line ends); n_chars is set anew, where there is one. A document of which nothing but white space is left goes.

    With text_hash, spans are cut out of the rows of their doc_id and text; without it, out of all rows of their doc_id.
    """
    columns = documents.columns
    of, of_text, gone, left = (f"_{name}_{uuid.uuid4().hex}" for name in ("of", "of_text", "gone", "left"))  # no column of documents is called that
    exact = "text_hash" in removed.columns
    by_doc = removed.groupBy(F.col("doc_id").alias(of), (F.col("text_hash") if exact else F.lit(0)).alias(of_text)).agg(F.collect_set(F.struct("start", "length")).alias(gone))
    same = documents["doc_id"].eqNullSafe(by_doc[of])
    joined = documents.join(by_doc, same & (_text_hash("text") == by_doc[of_text]) if exact else same, "left")

    @F.arrow_udf("string")
    def remaining(text: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([cut(t, g) if g and t else t for t, g in zip(text.to_pylist(), gone.to_pylist())], pa.string())

    # not deterministic to the optimizer, or the filter would ask a second Python worker of each task for the same texts
    kept = joined.withColumn(left, remaining.asNondeterministic()("text", gone)).where(F.col(gone).isNull() | (F.trim(left) != "")).withColumn("text", F.col(left))
    return (kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(documents.schema["n_chars"].dataType)) if "n_chars" in columns else kept).select(*columns)
