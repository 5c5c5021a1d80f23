"""Gold by classes: the same as its pairs, which are never made."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluate
from tidepool.plans import evaluating


def tables(spark):
    members = spark.createDataFrame([(i, i % 4 if i % 9 else None) for i in range(60)] + [(100, 7)], "id long, class int")
    asked = spark.createDataFrame([(0, None), (5, 1), (10, 2), (100, 7), (200, 3), (201, 8)], "query_id long, class int")
    predicted = spark.createDataFrame([(q, i * 7 % 61, i + 1) for q in (0, 5, 10, 100, 200, 300) for i in range(12)] + [(5, 5, 13), (10, 14, 14), (10, 14, 15)], "query_id long, id long, rank int")
    return predicted, asked, members


@pytest.mark.parametrize("k", [1, 5, 20])
def test_the_same_as_pairs(spark, k):
    predicted, asked, members = tables(spark)
    pairs, classes = members.join(asked, "class").filter("id <> query_id").select("query_id", "id"), evaluate.Classes(asked, members)
    rows = lambda df: sorted(map(tuple, df.select(*(F.round(c, 9) if c != "query_id" else c for c in df.columns)).collect()))
    for measure in (lambda g: evaluate.precision_recall(predicted, g, k), lambda g: evaluate.ndcg(predicted, g, k), lambda g: evaluate.weighted_support(predicted, g), evaluate.relevant):
        assert rows(measure(pairs)) == rows(measure(classes))
    assert evaluate.accuracy(predicted, pairs, asked, k).collect() == evaluate.accuracy(predicted, classes, asked, k).collect()
    assert {r.query_id: r.relevant for r in evaluate.relevant(classes).collect()} == {5: 12, 10: 12, 200: 14}


def test_measures_make_no_pairs_of_a_class(spark, tmp_path):
    """3000 rows of one class and 60 queries: the gold is counted, and not given as its 179,940 pairs."""
    spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), F.lit(3).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = evaluating.prepared(spark, str(tmp_path))
    assert not isinstance(made[1], type(made[0]))
    got = evaluating.leaderboard(spark, str(tmp_path))
    assert sorted(round(r.recall * 2999) for r in got.collect()) == [1, 5, 20]


def test_leaderboard_searches_once(spark, sf):
    assert "CoGroup" not in evaluating.leaderboard(spark, sf)._jdf.queryExecution().toString()
