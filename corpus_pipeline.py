"""From documents to packed sequences: language, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes what a stage returns as Parquet to
the shared folder and reads it again for the next one. All stages but the last keep the columns of documents.

- language: drops documents without a language (no letter) and those whose likeliest language scores below 0.4.
- near_duplicates: of each class of near-duplicates keeps the document with the smallest doc_id.
- decontamination: drops documents that contain a benchmark item.
- secrets: replaces secrets in the texts by their kind.
- packing: cuts the documents' ids into sequences of 1024.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import decontam, langid, minhash, packing, secrets
from pixelloom.llm.common import table, written

#: No SQL: the stages' models, signatures and tokenizers have none. Tests hold each stage against what its operator's own rows say, and the operators against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs, least=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
