"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are words and word beginnings that training labels show to be telling (lexicon voters) and a few forms of writing
(pattern voters). The label model takes each voter to fire with one probability in toxic and another in other texts, both
estimated by expectation-maximisation; voters that fire together beyond what the class explains share their weight. Its
posterior labels, not the given ones, train a logistic regression over the same voters. The given label is one more voter,
whose accuracy by class is estimated along with theirs. The model is fitted on a bounded sample
(SAMPLE texts of either label, drawn by id before any text is read); every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import CACHE_WORDS, WordHashes, mixed, row_batches, seeds, shingle_set, stored

SAMPLE, VOTERS = 6000, 800
#: Lengths of word beginnings that may become lexicon voters.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A lexicon voter occurs so many times as often in toxic texts as in others, with such a log-likelihood ratio (by chance, one in 2e7 words).
LEAST_RATIO, LEAST_SURENESS = 20.0, 28.0
#: Texts of either kind, right ones, that the given labels are taken to have had beforehand: keeps their accuracy below 1.
LABEL_PRIOR = 2.0
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")
_PATTERNS = (re.compile(r"!{2,}|\?!"), re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{4,}\b"), re.compile(r"[*#$%&@]{3,}"), re.compile(r"(\w)\1{3,}"), re.compile(r"https?://"))


def parts(word: str) -> list[str]:
    """What a word offers to the lexicon: itself (marked) and its beginnings."""
    return [f"{word}|", *(word[:n] for n in BEGINNINGS if n < len(word))]


def patterns(text: str) -> list[int]:
    """Which pattern voters fire: the pattern occurs at least once in 200 characters."""
    return [i for i, p in enumerate(_PATTERNS) if sum(1 for _ in p.finditer(text)) * 200 > len(text)]


@dataclass
class LabelModel:
    """Probability of each voter to fire by class, and the correlation of each two within a class.

    A voter that doesn't fire abstains; the last one fires where no lexicon voter does, and speaks for the other side. The
    evidence of a voter is divided among those that fire with it, as far as they are correlated.
    """

    prior: float
    fires: np.ndarray  # by class and voter
    together: np.ndarray  # by two voters

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        evidence = votes * np.log(self.fires[1] / self.fires[0]) / (1 + votes @ self.together)
        return np.log(self.prior / (1 - self.prior)) + evidence.sum(axis=1)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 6) -> tuple[LabelModel, np.ndarray]:
    """votes (texts by voters, 0 or 1) and the given labels -> model and posterior labels.

    The given labels start the rounds. Their own accuracy by class is estimated anew in each, as that of the voters is, and
    their log-odds are added to the voters'.
    """
    q = np.clip(given.astype(float), 0.02, 0.98)
    for _ in range(rounds):
        fires = np.stack([((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1), (q @ votes + 0.05) / (q.sum() + 1)])
        rest = votes - np.outer(q, fires[1]) - np.outer(1 - q, fires[0])
        spread = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        together = np.clip(rest.T @ rest / np.outer(spread, spread), 0, 1)
        together[together < 0.1] = 0
        np.fill_diagonal(together, 0)
        model = LabelModel(float(np.clip(q.mean(), 0.02, 0.98)), fires, together)
        voted = np.clip(model.log_odds(votes), -30, 30)
        right = [((1 - q) @ (1 - given) + LABEL_PRIOR) / ((1 - q).sum() + LABEL_PRIOR + 1), (q @ given + LABEL_PRIOR) / (q.sum() + LABEL_PRIOR + 1)]
        odds = np.where(given == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        q = 1 / (1 + np.exp(-np.clip(voted + odds, -30, 30)))
    return model, q


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1e-4, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both classes weigh the same."""
    share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
    row = q * 0.5 / share + (1 - q) * 0.5 / (1 - share)
    row /= row.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        e = (p - q) * row
        g = np.append(x.T @ e + ridge * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass
class ToxicityModel:
    lexicon: dict[str, int]
    weights: np.ndarray  # lexicon voters, then pattern voters
    bias: float
    labels: LabelModel

    def voters(self, text: str, cache: dict[str, tuple[int, ...]]) -> list[int]:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        fired: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            hit = cache.get(word)
            if hit is None:
                hit = cache[word] = tuple(self.lexicon[p] for p in parts(word) if p in self.lexicon)
            if hit:
                fired.update(hit)
        return [*fired, *(len(self.lexicon) + i for i in patterns(text))]

    def score(self, text: str, cache: dict[str, tuple[int, ...]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[self.voters(text, cache)].sum(), -60, 60))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Texts of either label that have each part, for one partition of the sample."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[toxic].update({p for w in set(_WORD.findall(text.lower())) for p in parts(w)})
    for part in found[0].keys() | found[1].keys():
        yield part, found[1][part], found[0][part]


def _unnested(found: dict[str, int]) -> list[str]:
    """Leave out a beginning where one longer part accounts for nine tenths of its texts."""
    covered = {b for part, n in found.items() for b in {part[:k] for k in range(1, len(part))} if b in found and n >= 0.9 * found[b]}
    return [part for part in found if part not in covered]


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Three minimum shingle hashes of each text, of which near copies share some."""
    cache, salts = WordHashes(), seeds(3, 31)
    for batch in batches:
        for doc, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            s = shingle_set(text.encode(), cache)
            yield doc, toxic, *((int((mixed(s * c)).min().view(np.int64)) for c in salts) if len(s) else (0, 0, 0))


def drawn(labels: DataFrame, most: int) -> DataFrame:
    """labels(doc_id, toxic) -> the ids of either label with the smallest hashes, `most` at most; an id with both labels is left out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    hashed = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    return hashed.where("toxic = 1").orderBy("h").limit(most).union(hashed.where("toxic = 0").orderBy("h").limit(most)).select("doc_id", "toxic")


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """documents(doc_id, text), labels(doc_id, toxic) -> model, from at most SAMPLE texts of either label, those of the smallest id hashes; None where a label is missing.

    Ids are drawn from the labels alone; they are few enough to be sent to one scan of the documents. Of an id with several
    texts the first counts. Of near copies one text counts, or their common words would seem telling.
    """
    ids = stored(drawn(labels, SAMPLE), "drawn")
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")  # 2 * SAMPLE ids at most
    sample = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("m1", pa.int64()), ("m2", pa.int64()), ("m3", pa.int64())])
    alike = sample.select("doc_id", "toxic", "text").mapInArrow(lambda b: row_batches(_likeness(b), schema), "doc_id long, toxic int, m1 long, m2 long, m3 long")
    for m in ("m1", "m2", "m3"):
        alike = alike.groupBy("toxic", m).agg(F.min(F.struct("doc_id", *(c for c in ("m1", "m2", "m3") if c != m))).alias("r")).select("toxic", m, "r.*")
    sample = stored(sample.join(F.broadcast(alike.select("doc_id")), "doc_id", "left_semi").select("text", "toxic"), "sample")
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not all(sizes.values()):
        return None
    schema = pa.schema([("part", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
    counts = sample.mapInArrow(lambda b: row_batches(_counted(b), schema, 10_000), "part string, pos long, neg long").groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = (F.col("pos") + 0.1) / (sizes[1] + 0.2) / ((F.col("neg") + 0.1) / (sizes[0] + 0.2))
    total = F.col("pos") + F.col("neg")
    fall = lambda n, share: F.when(n > 0, n * F.ln(n / (total * share))).otherwise(0.0)
    share = sizes[1] / (sizes[0] + sizes[1])
    sure = 2 * (fall(F.col("pos"), share) + fall(F.col("neg"), 1 - share))
    chosen = counts.where((ratio >= LEAST_RATIO) & (sure >= LEAST_SURENESS)).orderBy(F.desc(sure), "part").limit(4 * VOTERS).collect()
    lexicon = {part: i for i, part in enumerate(_unnested({r["part"]: r["pos"] for r in chosen})[:VOTERS])}
    draft = ToxicityModel(lexicon, np.empty(0), 0.0, LabelModel(0.5, np.empty((2, 0)), np.empty((0, 0))))

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield toxic, sorted(draft.voters(text, cache))

    schema = pa.schema([("toxic", pa.int32()), ("fired", pa.list_(pa.int32()))])
    rows = sample.mapInArrow(lambda b: row_batches(fired(b), schema), "toxic int, fired array<int>").collect()  # 2 * SAMPLE rows, give or take
    rows = sorted((r["toxic"], tuple(r["fired"])) for r in rows)
    votes = np.zeros((len(rows), len(lexicon) + len(_PATTERNS) + 1))
    for i, (_, on) in enumerate(rows):
        votes[i, list(on)] = 1
    votes[:, -1] = votes[:, : len(lexicon)].sum(axis=1) == 0
    labels, posterior = label_model(votes, np.array([t for t, _ in rows]))
    weights, bias = logistic(votes[:, :-1], posterior)
    return ToxicityModel(lexicon, weights, bias, labels)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def toxicity(documents: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score, predicted (1 from THRESHOLD on).

    A null or empty text has the score of a text in which no voter fires. Without a model every score is 0. Repeated rows
    come back each; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                score = model.score(text or "", cache) if model else 0.0
                yield doc, score, int(score >= THRESHOLD)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: row_batches(rows(b), _OUT), "doc_id long, score double, predicted int")
