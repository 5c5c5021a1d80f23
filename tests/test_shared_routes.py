"""A route that queries of a group share: the same results as its candidates one by one, and no pairs are shuffled."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidepool.operators import scoring as O
from tidepool.plans import registry
from tidepool.plans.scoring import WEIGHTS


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([(g, i, float(i % 3) / 2) for i in range(90) for g in (0, 1, 5) if (i + g) % 4 < 2] + [(None, 3, 1.0)], "group int, id long, score double")
    asked = spark.createDataFrame([(q, q % 3 if q else None) for q in range(20)], "query_id long, group int")
    own = spark.createDataFrame([(q, (q * 5 + i * 11) % 97, r, (i % 5 - 1) / 3.0) for q in range(22) for r in ("vec", "time") for i in range(12)], "query_id long, id long, route string, score double").distinct()
    shared = O.Shared("entity", rows, asked)
    return own, shared, own.unionByName(shared.named().join(asked, "group").select(own.columns))


def same(a, b):
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert sorted(a.columns) == sorted(b.columns)
    got, want = rows(a.select(b.columns)), rows(b)
    assert got == want and got


@pytest.mark.parametrize("size", [500_000, 40])
def test_the_same_as_one_by_one(spark, tables, monkeypatch, size):
    monkeypatch.setattr(O, "PAIRS", size)
    own, shared, every = tables
    same(O.ranked(own, ["query_id"], shared).drop(*O.CELL), O.ranked(every, ["query_id"]))
    same(O.fuse(own, ["query_id"], WEIGHTS, shared=shared), O.fuse(every, ["query_id"], WEIGHTS))
    aliases, text = spark.createDataFrame([(i, i - 1) for i in range(9, 97, 10)], "alias long, canonical long"), F.col("id").cast("string")
    priority = {"vec": 3, "entity": 2, "time": 1}
    pool = O.merge_pool(own.withColumn("text", text), aliases, priority, ["query_id"], replace(shared, rows=shared.rows.withColumn("text", text)))
    same(pool, O.merge_pool(every.withColumn("text", text), aliases, priority, ["query_id"]))


@pytest.mark.parametrize("n", [1, 7, 200])
def test_the_best_of_a_query(tables, n):
    own, shared, every = tables
    score = F.round(F.col("support") + 0.01 * F.col("routes") + (F.col("id") % 3) / 50, 6)
    want = O.top(O.fuse(every, ["query_id"], WEIGHTS).withColumn("final", score), ["query_id"], n, "final")
    same(O.fuse_top(own, WEIGHTS, shared, score, n), want)


@pytest.mark.parametrize("name", ["rank_per_route", "rrf_blend", "pool_merge", "v1_fusion"])
def test_no_pairs_are_shuffled(spark, sf, name):
    """Above the join on cells there is no exchange."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].split("\n")
    at = next(i for i, x in enumerate(lines) if "Join" in x and "_part" in x)
    above = [x for x in lines[:at] if "Exchange" in x]
    assert not above
