"""Nearest vectors in cells: the same as a scan of all pairs, row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import scoring
from tidepool.operators.nearest import nearest, same


def scan(q, v, k):
    pairs = v.join(q, F.lit(True)).select("query_id", "id", scoring.cosine(F.col("vector"), F.col("qvec")).alias("score"))
    return sorted((r.query_id, r.rank, r.id, r.score) for r in scoring.top(pairs, ["query_id"], k).collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    x = [list(map(float, r)) for r in rng.normal(size=(300, 5)).round(2)]
    x[40:160] = [x[3]] * 120  # copies
    x[161:166] = [None, [], [0.0] * 5, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0]]
    x[166] = [1e-170] * 5
    v = spark.createDataFrame([(i, r, i % 4) for i, r in enumerate(x)], "id long, vector array<double>, label int")
    return v.filter("id % 7 = 0 OR id BETWEEN 158 AND 167").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec")), v


@pytest.mark.parametrize("part, block", [(10_000, 10_000), (40, 9)])
def test_the_same_as_a_scan(spark, tables, part, block):
    q, v = tables
    got = scoring.top(nearest(q, v.select("id", "vector"), 6, block=block, part=part).withColumnRenamed("cos", "score"), ["query_id"], 6)
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got.collect()) == scan(q, v, 6)
    assert not nearest(q.limit(0), v, 3).collect() and not nearest(q, v.limit(0), 3).collect()


def test_few_rows_leave_a_cell_and_pairs_are_never_made(spark, tables):
    q, v = tables
    made = nearest(q, v.select("id", "vector"), 6)
    assert "NestedLoop" not in made._jdf.queryExecution().toString() and "Cartesian" not in made._jdf.queryExecution().toString()
    per = [r["count"] for r in made.groupBy("query_id").count().collect()]
    assert max(per) < 6 * 8 and sum(per) < 300 * len(per) / 10  # 120 copies tie, and the smallest six are enough


def test_weights_biases_and_groups(spark, tables):
    q, v = tables
    w = F.when(F.col("label") == 0, 1.0).otherwise(-0.5)
    got = nearest(q, v.withColumns({"w": w, "_weight": w, "_within": F.col("label")}), 1, part=100)
    best = {(r.query_id, r.label): r.s for r in got.groupBy("query_id", "label").agg(F.max(F.col("cos") * F.col("w")).alias("s")).collect()}
    pairs = v.join(q, F.lit(True)).withColumn("s", scoring.cosine(F.col("vector"), F.col("qvec")) * w)
    assert best == {(r.query_id, r.label): r.s for r in pairs.groupBy("query_id", "label").agg(F.max("s").alias("s")).collect()}
    own = v.withColumns({"b": F.col("label") / 3.0, "_bias": F.col("label") / 3.0, "_alike": same("label")})
    got = scoring.top(nearest(q, own, 4, part=64).withColumn("score", F.col("cos") + F.col("b")), ["query_id"], 4)
    want = scoring.top(v.join(q, F.lit(True)).withColumn("score", scoring.cosine(F.col("vector"), F.col("qvec")) + F.col("label") / 3.0), ["query_id"], 4)
    rows = lambda df: sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())
    assert rows(got) == rows(want)
