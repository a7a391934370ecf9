"""A training corpus from ``documents``: filter, deduplicate, clean, pack.

Each stage takes all that the one before it kept, as Parquet, and returns documents
(the last one, packed pieces).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripwright.llm import langid, nearcopies, packing, pii, quality
from tripwright.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores 0.5 or more; rows that repeat stay or go together."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("__tw_quality.score >= 0.5").drop("__tw_quality")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the decoder tells from the others; null and letterless texts go."""
    model = langid.train(docs)
    return langid.predict(docs, model).where("__tw_language.lang_pred <> 'und' AND NOT __tw_language.is_ambiguous").drop("__tw_language")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at a similarity of 0.8 or more connect: the row of the smallest (doc_id, text), null doc_ids last."""
    return nearcopies.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the labels of its kinds; a null text stays null."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their ids, each with its place in a sequence of 1024; null texts count as empty."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Learned models and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
