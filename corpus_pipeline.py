"""A training corpus from raw documents, in five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Stage 4 repeats a document for each copy that the mix takes and range-sorts them into training order, which its files
keep and stage 5 follows. The tests hold each stage against a brute-force version; SQL cannot express the classifier, so there is
none for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontaminate, jaccard, mixing, quality, shared, tokenfile


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled documents outside its test fold."""
    model = quality.fit(docs, shared.read_documents(spark, sf_dir, "labels"), shared.crc_mod("doc_id", 5) != 0)
    return quality.keep(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, shared.read_documents(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the curriculum takes, in order."""
    return mixing.curriculum(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file in training order, as its index read back: doc_id, start, n_tokens and ids_crc32 of each copy."""
    path = shared.new_path(spark, "pipeline-tokens")
    tokenfile.write_tokens(docs, path, order=tokenfile.stored_order(docs))
    return tokenfile.read_tokens(spark, path)


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
