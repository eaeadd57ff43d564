"""Cleaning pipeline over ``documents``: quality, toxicity, recurring lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and applies one operator.
Classifiers learn from ``labels`` and from the stage's own input texts. All stages but the last return the
columns of ``documents``. Near duplicates here are texts whose sets of five-word shingles have a similarity
(Jaccard) of at least 0.8, computed from the whole sets; the byte-position index of 64-bit fingerprints, at most
four bits apart, and bands of min-hashes only find the candidates. Of a component the row of the smallest id
stays (of repeated ids one row). Rows without an id are in no component's lead and stay only if no row of
their component has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dependra.llm import line_dedup, near_copies, packing, quality, toxicity
from dependra.llm._common import materialize, table

NEAR = {"words": 5, "bits": 4}  #: of the search for candidates
SIMILARITY = 0.8
COPIES = 0.8  #: similarity of lines from which a text is a copy of another one, which the near-duplicate stage judges whole


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, column="__quality").where(F.col("__quality") >= quality.THRESHOLD).drop("__quality")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prefix="__tox_").where(F.col("__tox_score") < 0.5).drop("__tox_score", "__tox_segments")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = line_dedup.drop_recurring_lines(docs, copies=COPIES)
    return got.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, **NEAR, similarity=SIMILARITY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Scores of trained models, components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
