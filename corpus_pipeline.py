"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Every stage but the last returns the columns of its input, whatever else they are called, and takes a null text for an
empty one; an empty table gives no rows; rows with a null ``doc_id`` are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphlens.llm import exact_dedup, minhash_forest, packing, suffix_dedup, toxicity
from graphlens.llm.common import staged

#: Bytes of a string that counts as a repeated passage: 50 words of four letters and a space.
PASSAGE_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text isn't predicted toxic; empty texts and repeated rows are judged as all others, and without labels all stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest ``doc_id``; all empty texts are one text, and of repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the smallest ``doc_id``; texts without words all stay."""
    return minhash_forest.drop_near_duplicates(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the strings of ``PASSAGE_BYTES`` or more that stand elsewhere too; a text may become empty, and a null one stays null."""
    return suffix_dedup.strip_repeats(docs, PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; an empty text is a document of its end id, and repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", strip_repeats),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs


#: Trained models, near duplicates and byte-pair ids aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
