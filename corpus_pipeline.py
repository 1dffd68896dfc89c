"""A training corpus from raw documents: five stages, each a pass over what the one before kept.

1. Language ID: texts without a letter, and those that no language's model fits, go.
2. N-gram Jaccard join: of each group of near copies the smallest doc_id stays.
3. Decontamination: documents that hold a test item go.
4. Secret scan: secrets are masked in place.
5. SentencePiece: the texts' pieces, with digests of what decoding gives back.

All but the last return the columns of documents.  An input without rows gives
an output without rows; where no text has a language, the first stage warns and
keeps all texts with a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaria.llm import decontamination, language_id, ngram_join, queries, secret_scan
from lexaria.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.sentencepiece_digest(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Frozen byte models, test-item search and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
