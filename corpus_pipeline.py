"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage works on all rows that its predecessor kept and is written to the shared scratch folder before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import compression_quality, decision_list, mixing, packing, simhash
from quern.llm.common import materialise, table, tuned


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.5 go."""
    model = compression_quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return compression_quality.keep_good(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go.

    The list is learned from the labelled documents of the corpus, not only of what the classifier kept: that lacks
    nearly all bad ones."""
    rules = decision_list.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return decision_list.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to flatter weights; every document is kept at least once."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Fitted models, fingerprints and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
