"""A training corpus from raw documents: five stages, each over all that the one before kept.

Language ID drops what is in no language, exact and near deduplication leave one document of
each group, personal data is replaced by its kind, and packing cuts token sequences. The first
four return the columns of ``documents``; the last returns the placed pieces with their doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import exact_dedup, language_id, near_dedup, packing, pii
from tallyfield.llm.common import checkpointed, documents


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs, words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("PII", redact),
    ("packing", pack),
]

#: Models, MinHash and token ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = checkpointed(docs)
    return docs
