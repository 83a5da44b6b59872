"""Corpus pipeline over ``documents``: quality classifier, exact dedup, MinHash
near-dedup (five-word shingles, similarity 0.8), best-fit packing.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next stage's ``docs``. All stages but the last return rows
of ``documents``. SQL cannot express the classifier or the tokenizer, so there
is no ORACLE_SQL; tests/llm compares run() with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, documents, table
from auditframe.llm.exact_dedup import keep_one_per_text
from auditframe.llm.importance import keep_resampled
from auditframe.llm.minhash import keep_one_per_group
from auditframe.llm.packing import pack
from auditframe.session import lineage_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the importance resampling rejects go."""
    return keep_resampled(Scratch(spark, "quality"), docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of equal texts stays."""
    return keep_one_per_text(Scratch(spark, "exact"), docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each near-duplicate group stays."""
    return keep_one_per_group(Scratch(spark, "near"), docs, shingle_words=5, similarity_percent=80).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the remaining documents as pieces of packed sequences."""
    out = pack(Scratch(spark, "packing"), docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table, and
    what a stage wrote besides goes when its result is written."""
    docs, before = documents(spark, sf_dir).select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, f"stage-{name}")
        with lineage_scope(spark):
            docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            before.release()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
