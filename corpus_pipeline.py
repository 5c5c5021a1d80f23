"""A training-corpus pipeline over `documents`: four stages, each on all that the one before kept.

Toxic documents go, then those that the quality rules reject, then all but the smallest doc_id of each group of near
duplicates (five words, similarity 0.8); the rest are packed. Between stages documents are written as Parquet to the
shared folder, so a lost executor costs at most a part of one stage.

Cases: those of the operators; a row without doc_id or repeated rows of a doc_id that stays go on to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import ngram_join, packing, quality_rules, toxicity
from tidepool.llm.common import table, written


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def rejected_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar(docs, n=5, percent=80)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_go), ("quality rules", rejected_go), ("n-gram Jaccard join", duplicates_go), ("packing", packed)]
#: Classifiers and tokenizers aren't SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
