"""A corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents,
except the last, which returns pieces of sequences. A row is one document; rows that share a doc_id are decided on together.
Extra columns are carried along. A stage on an empty table returns an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import decontaminate, language, line_dedup, near_dedup, packing
from archspark.llm.common import discard, stored, table, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go; it is trained on the rows that name one."""
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id."""
    return _without(docs, near_dedup.near_duplicates(docs).where("not kept"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out of the text; a document of which nothing is left goes."""
    return line_dedup.without_lines(docs, line_dedup.repeated_passages(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without a doc_id are told apart by their text."""
    found = decontaminate.contaminated_rows(docs, table(spark, sf_dir, "benchmark"))
    unnamed = F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(0)
    gone = found.select(F.col("doc_id").alias("_gone_id"), unnamed.alias("_gone_text")).distinct()
    own = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"].cast("string"))).otherwise(0)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (own == gone["_gone_text"]), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeated_passages), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: The first, third and last stage can't be said in SQL; tests/llm/test_llm.py checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again. What a stage wrote for itself is removed after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
