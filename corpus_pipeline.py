"""From raw documents to packed training sequences, in five stages.

Defined cases, in every stage: a null text counts as an empty one and stays null where the document stays; null ids are
kept; rows that repeat id and text are judged alike, and near-dedup keeps one of them; columns that a stage does not know,
whatever their names, pass through unchanged up to the last stage; an empty table gives an empty one; very long texts are
read whole. Of documents without labels of both kinds a classifier rejects all or none, by its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import features, packing, quality, secrets, sketch, toxicity
from lectern.llm.common import discard, materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return features.kept(docs, model, quality.score, lambda s: s >= quality.THRESHOLD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model marks go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return features.kept(docs, model, toxicity.score, lambda s: s < toxicity.THRESHOLD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (null ids last).

    Links are pairs with a Jaccard similarity of their five-word shingle sets of 0.8 or more. Candidates come from pigeonhole blocks,
    which lose no such pair, and are verified by the Hamming distance of SimHash fingerprints and then exactly. Texts without a
    word are copies of each other.
    """
    return sketch.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, their sequence and their offset in it."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
