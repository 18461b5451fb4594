"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

The model is trained by stochastic gradient descent in numpy on a bounded sample: WINDOWS windows of 2 to 60 words from
anywhere in each of SAMPLE texts per language (fewer of each where that is over BUDGET texts in all), cut in the tasks that
read them. Every label is learned. Every text is then scored whole. As the model is linear in the mean embedding, a word's
contribution is one row of logits, which a task caches; a text's words are counted first and looked up CHUNK at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import CACHE_WORDS, nothing_kept, row_batches

SAMPLE, BUDGET, WINDOWS = 1200, 240_000, 4
BUCKETS, DIM, EPOCHS = 1 << 15, 16, 3
SUBWORDS = (2, 3, 4)
#: Share of validation texts, plain ones and mixtures of two languages, that calibration lets each rejection rule reject.
REJECTED = 0.0005
#: Share of validation windows of a language left out of the known subwords that the coverage rule aims to let through.
LET_THROUGH = 0.01
#: Subwords of a text beyond these make its share of known ones no surer.
MOST_SUBWORDS = 400
#: A sampled text with a word of more letters than this gives no window with it.
MOST_LETTERS = 100

#: Distinct words of a text that are looked up at once.
CHUNK = 20_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case. Signs that count as numbers, such as a half or a Roman ten, are no letters."""
    found = _WORD.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):
        found = [w for run in found for w in (run if run.isalpha() else "".join(c if c.isalpha() else " " for c in run)).split()]
    return found


def subwords(word: str) -> list[int]:
    """Hashes of the word and of its character n-grams, with word marks."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in SUBWORDS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in [marked, *grams]]


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # by bucket: embedding times softmax weights
    seen: np.ndarray  # sorted whole hashes of the subwords that training met: they don't fill up as buckets do
    bias: np.ndarray
    temperature: float
    least_score: float
    usual_seen: float
    most_short: float

    def known(self, hashes: np.ndarray) -> np.ndarray:
        return _within(hashes, self.seen)


def _within(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


def _short(share: float, usual: float, n: float) -> float:
    """How far a share of known subwords among n falls short of the usual one, in terms of the spread that n leaves."""
    return (usual - share) * min(n, MOST_SUBWORDS) ** 0.5


def windows(text: str, seed: int) -> list[str]:
    """WINDOWS windows of 2 to 60 words of a text, so that short texts are calibrated too; none without a word."""
    rng = np.random.default_rng(seed)
    words = [w for w in words_of(text) if len(w) <= MOST_LETTERS]
    out = []
    for _ in range(WINDOWS):
        n = int(rng.integers(2, 60))
        at = int(rng.integers(0, max(1, len(words) - n)))
        out.append(" ".join(words[at : at + n]))
    return [w for w in out if w]


def train(examples: list[tuple[str, str, bool]], seed: int = 1) -> LanguageModel | None:
    """(window, language, held out for calibration) -> model; None without examples."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang, _ in examples})
    if not languages:
        return None
    known: dict[str, np.ndarray] = {}
    features, whole, labels, held = [], [], [], []
    for window, lang, out in examples:
        for w in window.split():
            if w not in known:
                known[w] = np.array(subwords(w), np.int64)
        whole.append(np.concatenate([known[w] for w in window.split()]).astype(np.uint32))
        features.append((whole[-1] % BUCKETS).astype(np.int64))
        labels.append(languages.index(lang))
        held.append(out)
    labels, held = np.array(labels), np.array(held)
    share = np.bincount(labels, minlength=len(languages)).astype(float)
    weight = (len(labels) / len(languages) / np.maximum(share, 1))[labels].clip(0.2, 20)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    train_rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(labels))
    steps, done = EPOCHS * max(1, len(train_rows) // 32), 0
    for _ in range(EPOCHS):
        rng.shuffle(train_rows)
        for batch in np.array_split(train_rows, max(1, len(train_rows) // 32)):
            rate = 0.5 * (1 - done / steps) + 0.01
            done += 1
            idx = np.concatenate([features[i] for i in batch])
            sizes = np.array([len(features[i]) for i in batch])
            mean = np.add.reduceat(E[idx], np.r_[0, sizes.cumsum()[:-1]], axis=0) / sizes[:, None]
            z = mean @ W + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= weight[batch][:, None]
            back = (p @ W.T).astype(np.float32)
            W -= rate * (mean.T @ p).astype(np.float32)
            b -= rate * p.sum(axis=0).astype(np.float32) / 4
            order = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.diff(idx[order], prepend=-1))  # where each subword's run begins
            steps_back = (back * (8 * rate / sizes[:, None]).astype(np.float32))[np.repeat(np.arange(len(batch)), sizes)[order]]
            E[idx[order][first]] -= np.add.reduceat(steps_back, first, axis=0)
    by_language = [np.unique(np.concatenate([np.empty(0, np.uint32), *(whole[i] for i in train_rows if labels[i] == y)])) for y in range(len(languages))]
    seen, languages_of = np.unique(np.concatenate(by_language), return_counts=True)
    table = (E @ W).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else train_rows
    z = np.array([table[features[i]].mean(axis=0) for i in check]) + b
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.2, 5, 40):
        loss = -(_log_softmax(z / t)[np.arange(len(check)), labels[check]]).mean()
        if loss < best:
            best, temperature = loss, float(t)
    top = np.exp(_log_softmax(z / temperature)).max(axis=1)
    shares = np.array([_within(whole[i], seen).mean() for i in check])
    usual = float(shares.mean())
    most_short = float(np.quantile([_short(c, usual, len(whole[i])) for c, i in zip(shares, check)], 1 - REJECTED))
    if len(languages) > 1:  # the same windows as if their language were unknown: subwords that it alone has don't count
        strange = []
        for i in check:
            place = np.minimum(np.searchsorted(seen, whole[i]), len(seen) - 1)
            others = languages_of[place] - _within(whole[i], by_language[labels[i]])
            strange.append(_short(float(((seen[place] == whole[i]) & (others > 0)).mean()), usual, len(whole[i])))
        most_short = max(most_short, (most_short + float(np.quantile(strange, LET_THROUGH))) / 2)
    mixed = np.exp(_log_softmax(_mixtures(table, b, [features[i] for i in check], labels[check], rng) / temperature)).max(axis=1)
    top = np.r_[top, mixed]
    return LanguageModel(languages, table, seen, b.astype(np.float64), temperature, float(np.quantile(top, REJECTED)), usual, most_short)


def _mixtures(table: np.ndarray, bias: np.ndarray, features: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Logits of validation windows, each joined to one of another language: a text that mixes known languages is no unknown one."""
    logits = []
    for i, sub in enumerate(features):
        others = np.flatnonzero(labels != labels[i])
        if len(others):
            logits.append(table[np.r_[sub, features[rng.choice(others)]]].mean(axis=0))
    return np.array(logits).reshape(-1, table.shape[1]) + bias


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


class _Rows(dict):
    """word -> row of summed logits, number of subwords and of those seen in training."""

    def __init__(self, model: LanguageModel):
        nothing_kept()
        self.model, self.table = model, np.zeros((1024, len(model.languages) + 2))

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of at most CHUNK distinct words; those that are new are looked up together."""
        if len(self) + len(words) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        while len(self) + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        if new:
            each = [subwords(w) for w in new]
            sizes = np.array([len(x) for x in each])
            whole = np.array([h for x in each for h in x], np.uint32)
            known, starts, first = self.model.known(whole), np.r_[0, sizes.cumsum()[:-1]], len(self)
            for at in range(0, len(new), 512):  # so that long words don't need a large table of logits at once
                here = slice(starts[at], starts[at + 512] if at + 512 < len(new) else len(whole))
                own = starts[at : at + 512] - starts[at]
                self.table[first + at : first + at + len(own), :-2] = np.add.reduceat(self.model.logits[whole[here] % BUCKETS], own, axis=0)
            self.table[first : first + len(new), -2], self.table[first : first + len(new), -1] = sizes, np.add.reduceat(known, starts, dtype=np.int64)
            self.update(zip(new, range(first, first + len(new))))
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def _judged(text: str | None, model: LanguageModel | None, cache: _Rows | None) -> tuple[str, float, bool]:
    counts = Counter(words_of(text)) if text and model else None
    if not counts:
        return "und", 0.0, False
    words, n = list(counts), np.fromiter(counts.values(), float, len(counts))
    total = sum(n[at : at + CHUNK] @ cache.rows(words[at : at + CHUNK]) for at in range(0, len(words), CHUNK))
    p = np.exp(_log_softmax((total[:-2] / total[-2] + model.bias) / model.temperature))
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] >= model.least_score and _short(total[-1] / total[-2], model.usual_seen, total[-2]) <= model.most_short)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, lang_pred, score, accepted.

    lang_pred is `und`, score 0 and accepted false where the text is null or has no letter, or where there is no model.
    accepted is false too where the calibrated score, or the share of subwords known from training, for so long a text, is below its threshold.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        cache = _Rows(model) if model else None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield doc, *_judged(text, model, cache)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: row_batches(rows(b), _OUT), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of documents, all columns, that `identify` accepts."""
    at = documents.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Rows(model) if model else None
        for batch in batches:
            yield batch.filter(pa.array([_judged(t, model, cache)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(rows, documents.schema)


_WINDOWS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("k", pa.int32()), ("text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lang, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for k, window in enumerate(windows(text, h & (2**63 - 1))):
                yield lang, h, k, window


def fit(labelled: DataFrame) -> LanguageModel | None:
    """labelled(doc_id, text, lang) -> model, from about SAMPLE rows of each language (BUDGET in all), by the hash of id and text.

    Only windows reach the driver, WINDOWS for each row of the sample. Repeated rows count once. A row in eight is held out to
    calibrate the temperature and the rejection.
    """
    known = labelled.where("lang is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.col("text"), F.col("lang"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    sample = min(SAMPLE, max(1, BUDGET // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], sample / r["count"])))
    drawn = (F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < F.element_at(share, F.col("lang"))
    cut = known.where(drawn).select("lang", "h", "text").mapInArrow(lambda b: row_batches(_cut(b), _WINDOWS), "lang string, h long, k int, text string").distinct()
    rows = cut.orderBy(F.shiftrightunsigned("h", 20), "h", "k", "lang").limit(WINDOWS * sample * len(counts)).collect()
    return train([(r["text"], r["lang"], (r["h"] >> 40) % 8 == 7) for r in rows])
