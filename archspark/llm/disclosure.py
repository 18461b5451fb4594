"""Personal data: patterns for what identifies by itself, and information theory for the terms that give it away.

The protected entities are the e-mail, IP, card and phone numbers that the patterns find. A term (a word outside of them)
discloses an entity e as far as it tells that e is near: with p the share of the corpus' words, PMI(t; e) =
log p(e|t) / p(e), and its ratio to the entity's own information -log p(e) is 1 where the term never occurs without the
entity and 0 where it says nothing of it. Terms of a ratio of REMOVED or more are removed, those of GENERALISED or more are
replaced by a general word, wherever they occur in the corpus. A pair counts if it occurs in SUPPORT different surroundings,
so that a text that mentions an entity once discloses nothing but the entity.

Counts cover all texts: a term's occurrences, an entity's surroundings, and those of them that have the term within WINDOW
words. Surroundings that occur again (copies) count once, and so do the term's occurrences in them: p(e|t) is the number of
different surroundings of both over that number and the term's other occurrences. In the last pass, a bit
table of fixed size, made on Spark from the disclosing terms, tells each task which words to look up; the join that
follows is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import CACHE_WORDS, nothing_kept, row_batches, stored

WINDOW, NEAR, SUPPORT = 16, 3, 3
REMOVED, GENERALISED = 0.95, 0.9
#: Bits of the table that tells tasks which words to look up (2 MB); with more terms than it serves, more words are looked up.
BITS = 1 << 24
SALTS = 32
KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract. An e-mail's part before the @ is found backwards from it (`emails`), and an
# IP number starts where no digit precedes, which gives the same matches in time linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = _digits(found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def identifiers(text: str) -> list[Span]:
    """The spans of KINDS, by kind as listed and start; kinds may overlap each other."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += ((kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group()))
    return spans


def entity(text: str, span: Span) -> str:
    """The entity a span names: its kind and value, without the marks between digits and the case of letters."""
    kind, a, b = span
    return f"{kind}:{text[a:b].lower() if kind in ('email', 'ip') else _digits(text[a:b])}"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The union of the spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def all_terms(text: str) -> Iterator[str]:
    """The words of a text without spans, in lower case."""
    return map(str.lower, _WORD.findall(text))


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Words in lower case, outside of the spans, with their places."""
    at = 0
    for a, b in (*covered(spans), (len(text), len(text))):
        for m in _WORD.finditer(text, at, a):
            yield m.group().lower(), *m.span()
        at = b


def _hash(text: str) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


#: entity 0 and surroundings 0: a term's occurrences in all; term 0: an entity's surroundings.
_COUNTS = pa.schema([("entity", pa.int64()), ("term", pa.int64()), ("surroundings", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    """A task's counts; what it holds is bounded and emitted when full."""
    nothing_kept()
    seen, near = Counter(), Counter()

    def emitted():
        yield from ((0, _hash(w), 0, n) for w, n in seen.items())
        yield from ((*key, n) for key, n in near.items())
        seen.clear()
        near.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = identifiers(text)
            if not spans:
                seen.update(all_terms(text))
            else:
                words = list(terms(text, spans))
                seen.update(w for w, _, _ in words)
                starts = [a for _, a, _ in words]
            for span in spans:
                e = _hash(entity(text, span))
                here = int(np.searchsorted(starts, span[1]))
                window = [w for w, _, _ in words[max(0, here - WINDOW) : here + WINDOW]]
                about = _hash(" ".join(w for w, _, _ in words[max(0, here - NEAR) : here + NEAR])) or 1
                near[e, 0, about] += 1
                for w in set(window):
                    near[e, _hash(w), about] += 1
            if len(seen) + len(near) >= CACHE_WORDS:
                yield from emitted()
    yield from emitted()


def disclosing(documents: DataFrame, removed: float = REMOVED, generalised: float = GENERALISED) -> DataFrame:
    """Terms that disclose an entity: term (hash), ratio (the largest over the entities), removed (or else generalised)."""
    counts = documents.select(F.col("text").cast("string")).mapInArrow(lambda b: row_batches(_counted(b), _COUNTS), "entity long, term long, surroundings long, n long")
    counts = stored(counts.groupBy("entity", "term", "surroundings").agg(F.sum("n").alias("n")), "disclosure-counts")
    in_all = counts.where("entity = 0").select("term", F.col("n").alias("of_term"))
    total = in_all.agg(F.sum("of_term")).first()[0] or 0
    of_entity = counts.where("term = 0").groupBy("entity").agg(F.count("*").alias("of_entity"))
    pairs = counts.where("entity != 0 and term != 0").groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("different")).where(F.col("different") >= SUPPORT)
    elsewhere = F.greatest(F.col("of_term") - F.col("both"), F.lit(0))
    share = F.col("different") / (elsewhere + F.col("different"))
    ratio = 1 + F.log(share) / F.log(F.lit(float(total)) / F.col("of_entity"))
    found = pairs.join(in_all, "term").join(of_entity, "entity").where(F.col("of_entity") < total).select("term", ratio.alias("ratio"))
    return stored(found.groupBy("term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= generalised).withColumn("removed", F.col("ratio") >= removed), "disclosure-terms")


def bit_table(found: DataFrame) -> np.ndarray:
    """BITS bits as 64-bit words, two bits set for each term. Spark makes it; the driver gets BITS / 64 words at most."""
    bits = found.select(F.explode(F.array(*(F.shiftrightunsigned("term", s).bitwiseAND(F.lit(BITS - 1)) for s in (0, 32)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("word"))
    table = np.zeros(BITS // 64, np.int64)
    for r in words.collect():
        table[r["at"]] = r["word"]
    return table


_PLACE = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("maybe", _PLACE)])
_FOUND_DDL = f"row long, doc_id long, key string, {', '.join(f'n_{k} long' for k in KINDS)}, base string, maybe array<struct<term: long, start: long, stop: long>>"


def _located(table: np.ndarray):
    """row, doc_id, key, text -> its identifiers, and the places of words that may disclose."""
    octets, some = table.astype("<i8").tobytes(), bool(table.any())

    class Listed(dict):
        """word -> its hash if the table may have it, else None; emptied when it is full."""

        def __missing__(self, word: str) -> int | None:
            if len(self) >= CACHE_WORDS:
                self.clear()
            h = _hash(word)
            a, b = h & (BITS - 1), (h >> 32) & (BITS - 1)
            found = self[word] = h if octets[a >> 3] >> (a & 7) & 1 and octets[b >> 3] >> (b & 7) & 1 else None
            return found

    def rows(batches):
        nothing_kept()
        listed = Listed()
        for batch in batches:
            for row, doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text, maybe = text or "", []
                spans = identifiers(text)
                if some and (spans or any(listed[w] is not None for w in set(all_terms(text)))):
                    maybe = [{"term": h, "start": a, "stop": b} for w, a, b in terms(text, spans) if (h := listed[w]) is not None]
                counts = Counter(k for k, _, _ in spans)
                yield row, doc, key, *(counts[k] for k in KINDS), joined(spans), maybe

    return lambda batches: row_batches(rows(batches), _FOUND, 500)


def located(documents: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each document: row, doc_id, key (digest of the text), n_<kind>, base (identifiers as kind:start:end), added (disclosing terms: start, stop, removed)."""
    text = F.col("text").cast("string")
    rows = documents.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.sha2(text, 256), text)
    rows = stored(rows.mapInArrow(_located(bit_table(found)), _FOUND_DDL), "disclosure-located")
    salted = found.select("term", "removed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = rows.select("row", F.explode("maybe").alias("m")).select("row", "m.*", (F.col("row") % SALTS).cast("int").alias("salt"))
    added = asked.join(salted, ["term", "salt"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "removed"))).alias("added"))
    nothing = F.array().cast("array<struct<start: long, stop: long, removed: boolean>>")
    shown = ["row", "doc_id", "key", *(f"n_{k}" for k in KINDS), "base"]
    asking = rows.where(F.size("maybe") > 0).select(shown).join(added, "row", "left").withColumn("added", F.coalesce("added", nothing))
    return rows.where(F.size("maybe") == 0).select(*shown, nothing.alias("added")).unionByName(asking)


def _spans(named):
    """base and the added terms as text; named gives an added term's kind."""
    added = F.array_join(F.transform("added", lambda x: F.concat(named(x), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")
    return F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(added != "", added))


def personal_data(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Counts and spans of personal data in every document, and the terms that disclose it.

    base_sha256 is the digest of the patterns' spans alone. A null or empty text has none. Rows of one doc_id, and equal
    rows, are documents of their own; an empty table gives no rows; other columns are ignored. `found` are terms learned
    before (`disclosing`); by default they are learned from the same documents.
    """
    found = disclosing(documents) if found is None else found
    spans = _spans(lambda x: F.lit("term"))
    return located(documents, found).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_terms"))


def general(word: str) -> str:
    """What stands for a disclosing word that is not removed."""
    return "[number]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[word]"


def replaced(text: str, spans: str) -> str:
    """The text with its spans replaced: identifiers by their kind, terms by a general word or nothing."""
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if b <= at:
            continue
        out += (text[at:max(a, at)], "" if kind == "removed" or a < at else general(text[a:b]) if kind == "general" else f"[{kind}]")
        at = b
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """documents with identifiers and disclosing terms replaced in text; all other columns as they were, clean texts too."""
    found = disclosing(documents) if found is None else found
    spans = _spans(lambda x: F.when(x["removed"], F.lit("removed")).otherwise(F.lit("general")))
    key, put_at = (f"{max(documents.columns, key=len)}_{x}" for x in ("key", "spans"))  # names that documents lack
    of_text = located(documents, found).select(F.col("key").alias(key), spans.alias(put_at)).where(F.col(put_at) != "").groupBy(key).agg(F.first(put_at).alias(put_at))

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, s) if s else t for t, s in zip(text, spans)], dtype=object)

    text = F.col("text").cast("string")
    met = documents.join(of_text, F.sha2(text, 256) == F.col(key), "left")
    return met.select(*(F.when(F.col(put_at).isNull(), text).otherwise(put(text, F.col(put_at))).alias("text") if c == "text" else documents[c] for c in documents.columns))
