"""Evaluation with labels as gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as O
from ..operators import scoring as Sc
from ..operators.nearest import nearest
from ..sources import tables as S
from ..sources.store import stored
from .registry import query
from .scoring import COS

PRED = f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label = q.label AS rel, {COS} AS s FROM embeddings e, q WHERE e.vec_id <> q.vec_id),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM c QUALIFY rank <= 20), g AS (SELECT query_id, id FROM c WHERE rel)"""


def prepared(spark: SparkSession, d: str) -> tuple[DataFrame, O.Classes]:
    v = S.vectors(spark, d)
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), F.col("label").alias("ql"))
    pairs = nearest(q.drop("ql"), v.select("id", "vector"), 21).filter("id <> query_id")  # ids occur once, so one of 21 at most goes
    predicted = Sc.top(pairs.withColumnRenamed("cos", "score"), ["query_id"], 20)
    return predicted, O.Classes(q.select("query_id", F.col("ql").alias("class")), v.select("id", F.col("label").alias("class")))


@query("precision_recall_at_k", f"{PRED} SELECT g.query_id, round(count(p.id) / 10.0, 6) AS precision, round(count(p.id) / count(*), 6) AS recall FROM g LEFT JOIN (SELECT * FROM p WHERE rank <= 10) p USING (query_id, id) GROUP BY 1")
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return O.precision_recall(*prepared(spark, d), 10).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("ndcg_at_k", f"{PRED}, x AS (SELECT query_id, sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, least(count(*) FILTER (rel), 10) AS n FROM p GROUP BY 1) SELECT query_id, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM x")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return O.ndcg(*prepared(spark, d), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("weighted_support", f"{PRED} SELECT g.query_id, round(avg(coalesce(1 / log2(p.rank + 1), 0)), 6) AS support FROM g LEFT JOIN p USING (query_id, id) GROUP BY 1")
def weighted_support(spark: SparkSession, d: str) -> DataFrame:
    return O.weighted_support(*prepared(spark, d)).select("query_id", F.round("support", 6).alias("support"))


@query("acc_at_k", f"{PRED} SELECT round(avg(CASE WHEN vec_id IN (SELECT query_id FROM p WHERE rel AND rank <= 3) THEN 1 ELSE 0 END), 6) AS accuracy FROM embeddings WHERE vec_id % 50 = 0")
def acc_at_k(spark: SparkSession, d: str) -> DataFrame:
    p, g = prepared(spark, d)
    q = S.vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"))
    return O.accuracy(p, g, q, 3).select(F.round("accuracy", 6).alias("accuracy"))


@query("leaderboard", f"{PRED}, k AS (SELECT unnest([1, 5, 20]) AS k) SELECT 'top' || k AS config, round(avg(h), 6) AS recall FROM (SELECT k, g.query_id, count(p.id) / count(*) AS h FROM k, g LEFT JOIN p ON p.query_id = g.query_id AND p.id = g.id AND p.rank <= k.k GROUP BY 1, 2) GROUP BY k")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    p, g = prepared(spark, d)
    p = stored(p, "predicted")  # each k would search again
    runs = [O.precision_recall(p, g, k).select(F.lit(f"top{k}").alias("config"), "query_id", "recall") for k in (1, 5, 20)]
    return O.leaderboard(runs[0].union(runs[1]).union(runs[2]), "recall").select("config", F.round("recall", 6).alias("recall"))


@query("time_error", "SELECT user_id, abs(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-28')) AS days FROM events GROUP BY 1")
def time_error(spark: SparkSession, d: str) -> DataFrame:
    """Days between the last mention found and the expected date."""
    last = S.events(spark, d).groupBy("user_id").agg(F.max("t").alias("t"))
    return last.select("user_id", F.abs(F.datediff(F.lit("2024-01-28").cast("date"), F.col("t").cast("date"))).cast("long").alias("days"))


@query("speaker_precision", "SELECT conv_id AS query_id, round(avg(CASE WHEN role = 'user' THEN 1 ELSE 0 END), 6) AS precision FROM conversations GROUP BY 1")
def speaker_precision(spark: SparkSession, d: str) -> DataFrame:
    t = S.parquet(spark, d, "conversations", "conv_id", "role")
    return t.groupBy(F.col("conv_id").alias("query_id")).agg(F.round(F.avg(F.when(F.col("role") == "user", 1).otherwise(0)), 6).alias("precision"))


@query("ground_truth_topics", "SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY 1 ORDER BY events DESC, entity_id LIMIT 20")
def ground_truth_topics(spark: SparkSession, d: str) -> DataFrame:
    return S.involves(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "entity_id").limit(20)
