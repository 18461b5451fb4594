"""The queries opN_<name>: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import clusters, decontaminate, disclosure, fingerprint, html_text, katz, language, licenses, line_dedup, manifest, near_dedup, packing, toxicity
from archspark.llm.common import crc_mod, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(documents.where(~held_out))
    return language.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.fit(documents))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz.katz_scores(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_data(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_repeated_passages that SQL can express: units of whole lines."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_html_text, op4_language, op5_packing, op6_decontamination, op7_licences, op8_katz, op9_near_duplicates, op10_repeated_passages, op11_personal_data, op12_manifest, op13_clusters, repeated_lines)}
