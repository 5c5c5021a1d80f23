"""Retrieval quality from tables: gold (query_id, id) or by classes, and ranked predictions (query_id, id, rank)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classes:
    """Gold that goes by classes: relevant to a query (asked: query_id, class) are all rows of its class (members: id, class) but itself.

    Its pairs grow with the square of a class and are never made: rows are counted by class, and predictions looked up. A null class has no rows."""

    asked: DataFrame
    members: DataFrame


def relevant(gold: DataFrame | Classes) -> DataFrame:
    """(query_id, relevant): how many different ids are relevant to a query, where any is."""
    if isinstance(gold, DataFrame):
        return gold.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    members = gold.members.select("id", "class").distinct()
    own = members.select(F.col("id").alias("query_id"), "class", F.lit(1).alias("_own"))
    asked = gold.asked.select("query_id", "class").distinct().join(members.groupBy("class").agg(F.count(F.lit(1)).alias("_n")), "class").join(own, ["query_id", "class"], "left")
    return asked.select("query_id", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("relevant")).filter("relevant > 0")


def judged(predicted: DataFrame, gold: DataFrame | Classes) -> DataFrame:
    """Predictions with `rel`: 1 for what is relevant, else 0."""
    if isinstance(gold, DataFrame):
        return predicted.join(gold.select("query_id", "id", F.lit(1).alias("rel")).distinct(), ["query_id", "id"], "left").fillna(0, ["rel"])
    asked, members = gold.asked.select("query_id", "class").distinct(), gold.members.select("id", "class", F.lit(1).alias("_in")).distinct()
    rel = F.when(F.col("id") != F.col("query_id"), F.col("_in"))
    return predicted.join(asked, "query_id", "left").join(members, ["id", "class"], "left").withColumn("rel", F.coalesce(rel, F.lit(0))).drop("class", "_in")


def precision_recall(predicted: DataFrame, gold: DataFrame | Classes, k: int) -> DataFrame:
    """Per query of the gold: precision and recall of its k first different ids."""
    p = judged(predicted.filter(F.col("rank") <= k).select("query_id", "id").distinct(), gold)
    found = p.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.sum("rel").alias("hits"))
    out = relevant(gold).join(found, "query_id", "left").fillna(0, ["returned", "hits"])
    return out.select("query_id", F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"))


def ndcg(predicted: DataFrame, gold: DataFrame | Classes, k: int) -> DataFrame:
    """Per query of the predictions: binary gain, the ideal from what is relevant among its candidates."""
    rel = judged(predicted, gold)
    gain = F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    per = rel.groupBy("query_id").agg(gain.alias("dcg"), F.least(F.sum("rel"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    return per.select("query_id", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def weighted_support(predicted: DataFrame, gold: DataFrame | Classes) -> DataFrame:
    """Per query: the mean over its gold of 1 / log2(first rank + 1); those not found count zero."""
    first = judged(predicted.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), gold).filter("rel = 1")
    gain = first.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    return relevant(gold).join(gain, "query_id", "left").select("query_id", (F.coalesce("gain", F.lit(0.0)) / F.col("relevant")).alias("support"))


def accuracy(predicted: DataFrame, gold: DataFrame | Classes, queries: DataFrame, k: int) -> DataFrame:
    """One row: the share of all queries with a gold id among the k first. Queries without gold stay in the denominator."""
    hit = judged(predicted.filter(F.col("rank") <= k), gold).filter("rel = 1").select("query_id").distinct().withColumn("hit", F.lit(1))
    return queries.select("query_id").distinct().join(hit, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


def leaderboard(scores: DataFrame, metric: str) -> DataFrame:
    """Mean of each metric per configuration, best first."""
    metrics = [c for c in scores.columns if c not in ("config", "query_id")]
    return scores.groupBy("config").agg(*(F.avg(m).alias(m) for m in metrics)).orderBy(F.desc(metric), "config")
