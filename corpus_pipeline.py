"""The training-data pipeline: quality classifier, quality rules, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents. Stages that learn read the labels from sf_dir.

In every stage: rows with null ids, texts, languages or sources and repeated rows are rows like others, and repeated rows
of one id stay or go alike but for mixing, whose quota may take some of them; null and empty texts never pass the rules;
texts of any length are read whole; further columns stay, whatever their names; an empty table gives an empty one. Ties:
see the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushjoin.llm import mixing, near_dups, packing, quality_classifier, quality_rules
from hushjoin.llm.common import Scratch, scratch_scope, table

#: SQL cannot express the classifier or MinHash: tests compare each stage with a plain version of its own.
ORACLE_SQL = None

#: Stage 4 takes each selected document once: packing then sees no document twice.
MIX = mixing.Mix(budget_percent=90, epochs=1)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected."""
    return quality_rules.keep_quality(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return near_dups.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights select."""
    return mixing.keep_mix(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_dups", dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again. Only the last result is left."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        with scratch_scope():
            docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs
