"""Answers about an architecture: evidence that is missing, confidence, citations and the evidence block of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons of a confidence label, in order.
REASONS = ("exact_match", "has_ir_evidence", "has_graph_evidence", "partial_sources", "truncated_context", "missing_required_evidence", "provider_unavailable")


def confidence(answers: DataFrame) -> DataFrame:
    """answers(id, matched: array of names, kinds, names: arrays over the evidence, n_citations, flags: array, missing: array of reasons) -> id, confidence, reasons.

    Without evidence, or flagged so, INSUFFICIENT_EVIDENCE; LOW where citations failed or the context is stale, cut or a
    provider away; HIGH for an exact match backed by IR and graph with citations; else MEDIUM.
    """
    flag = lambda f: F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), f)
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    low = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))
    exact = F.arrays_overlap(low("matched"), low("names"))
    away = flag("MODEL_UNAVAILABLE") | F.exists(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.lower(m).contains("unavailable"))
    ir, graph = F.array_contains(kinds, "IR"), F.array_contains(kinds, "GRAPH")
    held = (exact, ir, graph, flag("PARTIAL"), flag("TRUNCATED_CONTEXT"), flag("INSUFFICIENT_EVIDENCE"), away)
    label = F.when(flag("INSUFFICIENT_EVIDENCE") | (F.size(kinds) == 0), "INSUFFICIENT_EVIDENCE").when(flag("CITATION_VALIDATION_FAILED") | flag("STALE_CONTEXT") | flag("TRUNCATED_CONTEXT") | away, "LOW").when(exact & ir & graph & (F.col("n_citations") > 0), "HIGH").otherwise("MEDIUM")
    return answers.select("id", label.alias("confidence"), F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(held, REASONS)))).alias("reasons"))


def known_citations(answer: Column, n_evidence: Column) -> Column:
    """An answer with citations [E<k>] of evidence that isn't there replaced by [citation_removed]."""
    return F.aggregate(_unknown(answer, n_evidence), answer, lambda text, c: F.replace(text, c, F.lit("[citation_removed]")))


def _unknown(answer: Column, n_evidence: Column) -> Column:
    """Labels in brackets that begin with E and are none of E1 to E<n_evidence>."""
    number = lambda c: F.regexp_extract(c, r"^\[E([1-9]\d{0,8})\]$", 1).try_cast("int")
    return F.filter(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[E[^\]]+\]"), 0)), lambda c: ~F.coalesce(number(c).between(1, n_evidence), F.lit(False)))


# Kinds of evidence that an intent needs, names of missing sources, words of a factual question, kinds that carry an answer.
REQUIRED = {"ARCHITECTURE_TOPOLOGY": ("IR", "ARCHITECTURE", "GRAPH"), "DEPENDENCY": ("GRAPH", "DEPENDENCY"), "ENDPOINT_LOOKUP": ("IR", "ENDPOINT")}
SOURCES = {"IR": "IR", "GRAPH": "graph", "ARCHITECTURE": "component index", "ENDPOINT": "endpoint data", "CONTEXT_METADATA": "active context"}
FACTUAL = "architecture|dependency|dependencies|finding|findings|risk|risks|change|changes|changed|test|tests|endpoint|service|commit"
STRONG = ("IR", "GRAPH", "ENDPOINT", "DEPENDENCY", "ARCHITECTURE")
_NONE = "array<string>"


def _guarded(intent: Column, question: Column) -> Column:
    return F.coalesce(intent.isin(*REQUIRED), F.lit(False)) | F.coalesce(F.lower(question).rlike(FACTUAL), F.lit(False))


def _weak(kinds: Column, origins: Column) -> Column:
    strong = F.arrays_overlap(F.array_compact(kinds), F.array(*map(F.lit, STRONG)))
    return ~strong | F.forall(origins, lambda o: F.coalesce(F.contains(F.lower(o), F.lit("inferred")), F.lit(False)))


def before_generation(asked: DataFrame, strict: bool = False) -> DataFrame:
    """asked(id, question, intent, kinds: array over the evidence, origins: array of their confidence sources, missing: array of kinds that retrieval missed, no_context: boolean) -> id, missing_sources, flag, blocked.

    Questions of an intent that needs evidence, or with a factual word, are guarded; the others have no flag. Blocked with
    INSUFFICIENT_EVIDENCE without any evidence, with none of the kinds that the intent needs, or (strict) with weak evidence
    only: no strong kind, or all inferred. PARTIAL where some source is missing.
    """
    needed = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    label = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
    need = F.coalesce(F.try_element_at(needed, F.coalesce("intent", F.lit(""))), F.array().cast(_NONE))
    kinds = F.coalesce("kinds", F.array().cast(_NONE))
    named = lambda c: F.transform(F.array_compact(c), lambda k: F.coalesce(F.try_element_at(label, k), F.lower(k)))
    context = F.when(F.coalesce("no_context", F.lit(False)), F.array(F.lit("active context"))).otherwise(F.array().cast(_NONE))
    missing = F.array_distinct(F.concat(named(F.coalesce("missing", F.array().cast(_NONE))), context, named(F.array_except(need, kinds))))
    blocked = (F.size(kinds) == 0) | ((F.size(need) > 0) & ~F.arrays_overlap(F.array_compact(kinds), need))
    if strict:
        blocked = blocked | _weak(kinds, F.coalesce("origins", F.array().cast(_NONE)))
    guarded = _guarded(F.col("intent"), F.col("question"))
    out = asked.select("id", guarded.alias("g"), F.when(guarded, missing).otherwise(F.array().cast(_NONE)).alias("missing_sources"), (guarded & blocked).alias("blocked"))
    flag = F.when(F.col("blocked"), "INSUFFICIENT_EVIDENCE").when(F.size("missing_sources") > 0, "PARTIAL")
    return out.select("id", "missing_sources", flag.alias("flag"), "blocked")


def after_generation(answered: DataFrame, strict: bool = False) -> DataFrame:
    """answered(id, question, intent, answer, citations: array of artifact ids, artifacts: array of those of the evidence, kinds, origins) -> id, answer, citations, flags, confidence (null where it stays).

    Citations of unknown evidence go, from the text and from the list; an answer that is left with none, or (strict) rests on
    weak evidence, is replaced by a note. Questions that aren't guarded keep their answer.
    """
    empty = F.array().cast(_NONE)
    cited, artifacts = F.coalesce("citations", empty), F.array_compact(F.coalesce("artifacts", empty))
    said = F.coalesce(F.trim("answer") != "", F.lit(False))
    kept = F.filter(cited, lambda c: F.coalesce(F.array_contains(artifacts, c), F.lit(False)))
    n = F.size(F.coalesce("artifacts", empty))
    unknown = said & (F.size(_unknown(F.coalesce("answer", F.lit("")), n)) > 0)
    none, lost, bare = said & (F.size(cited) == 0), F.size(kept) < F.size(cited), said & (F.size(kept) == 0)
    weak = _weak(F.coalesce("kinds", empty), F.coalesce("origins", empty)) if strict else F.lit(False)
    text = F.when(none, "Insufficient citation support: generated answer did not include valid evidence citations.").when(bare, "Insufficient citation support: no valid citations remain after validation.")
    text = text.when(weak, "Insufficient evidence: strict evidence-only mode requires stronger direct support.").otherwise(F.when(said, known_citations(F.col("answer"), n)).otherwise(F.col("answer")))
    flags = F.array_compact(F.array(F.when(unknown | none | lost, "CITATION_VALIDATION_FAILED"), F.when(none | bare | weak, "INSUFFICIENT_EVIDENCE")))
    level = F.when(none | bare | weak, "INSUFFICIENT_EVIDENCE").when(unknown | lost, "LOW")
    g = _guarded(F.col("intent"), F.col("question"))
    return answered.select("id", F.when(g, text).otherwise(F.col("answer")).alias("answer"), F.when(g & ~none, kept).otherwise(F.col("citations")).alias("citations"), F.when(g, flags).otherwise(empty).alias("flags"), F.when(g, level).alias("confidence"))


# Labels of the context and of a record, in order, and the columns they show.
SUMMARY = {"system": "system", "commit": "commit", "service": "service", "endpoint": "endpoint"}
RECORD = {"id": "id", "artifactType": "kind", "artifactId": "artifact", "artifactVersion": "version", "locationHint": "location", "entity": "entity", "service": "service", "endpoint": "path", "antiPatterns": "markers", "content": "content"}


def evidence_block(contexts: DataFrame, rows: DataFrame, title: str = "EvidenceRecords") -> DataFrame:
    """contexts(query, truncated, stale, has_context, system, commit, service, endpoint), rows(query, place and the RECORD's columns), ranked and bounded per query -> query, block: title, context, state, number of records, and a record for each row in order; blank values are n/a."""
    known = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")), F.lit("n/a"))
    shown = lambda labels, sep: F.concat_ws(sep, *(F.concat(F.lit(f"{label}="), known(c)) for label, c in labels.items()))
    record = F.concat(F.lit("- EvidenceRecord { "), shown(RECORD, "; "), F.lit(" }\n"))
    by = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", record.alias("line")))).alias("l"))
    head = F.concat(F.lit(f"{title}:\n"), F.when(F.col("has_context"), F.concat(F.lit("ContextSummary: "), shown(SUMMARY, ", "), F.lit("\n"))).otherwise(""))
    state = F.concat(F.lit("EvidenceState: truncated="), F.col("truncated").cast("string"), F.lit(", staleContext="), F.col("stale").cast("string"), F.lit("\n"))
    listed = F.concat(F.lit("EvidenceCount: "), F.size("l").cast("string"), F.lit("\nEvidenceList:\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""))
    return contexts.join(by, "query", "left").select("query", F.concat(head, state, F.when(F.col("l").isNull(), "EvidenceCount: 0\nEvidenceList: none\n").otherwise(listed)).alias("block"))
