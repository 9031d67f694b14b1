"""Documents to training sequences: language, toxicity and near-duplicate filters, then packing.

Each stage reads what its predecessor kept and decides by an operator of feedweave.llm; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedweave.llm import language_id, minhash_dedup, packing, toxicity
from feedweave.llm.common import stored, table

LEAST_SCORE = 0.5  # of the predicted language
NEAR_PERCENT = 80  # Jaccard similarity of the word shingles of near-duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose best language has a score under LEAST_SCORE; each row by its own text."""
    return language_id.identify(docs, carry=True).where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by a model learned from the labelled ones among them; each row by its own text."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), carry=True).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id; rows without a doc_id stay.

    Rows that repeat a doc_id are one document: they stay or go together, and go if the text of any is a near copy of a document with
    a smaller id.
    """
    gone = stored(minhash_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None  # models and token ids are beyond SQL; tests/llm/test_pipeline.py compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
