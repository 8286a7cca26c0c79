"""The corpus pipeline: five stages over documents, each a table that the next one reads.

All stages take any rows of documents: extra columns are left out, null ids stay what they are, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import decontam, jaccard_join, langid, packing, secret_scan
from sieveworks.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters (null and empty texts too), or far from every centroid. Repeated rows go or stay alike; without labels all go."""
    return langid.keep_identified(docs.select(COLUMNS), langid.learn_from_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word Jaccard 0.8 links, the one with the least id. Null and empty texts are linked with nothing and stay; rows equal in id and text become one; rows without an id stay."""
    return jaccard_join.keep_one(docs.select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item. Null and empty texts stay; repeated rows go or stay alike; without items all stay."""
    return decontam.remove_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows a text that changed, and no document is dropped. Null texts stay null; repeated rows are masked each."""
    masked = secret_scan.redact(docs.select(*COLUMNS, F.col("text").alias("__before")))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 ids. A null or empty text is its end id alone; repeated rows are packed each."""
    return packing.with_packing(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: Components, a learned classifier and packing aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
