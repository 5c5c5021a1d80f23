"""Composed searches on small rows: unknown and null rows, ties, switches, scopes and outside scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.functions.literals import timestamp
from tidepool.operators import retrieval as R
from tidepool.operators import scoring as O

NOW = dt.datetime(2024, 1, 3)


@pytest.fixture(scope="module")
def parts(spark):
    hits = [(1, "a", "vec", 0.9), (1, "b", "vec", 0.8), (1, "b2", "vec", 0.95), (1, "a", "time", 0.7), (1, "c", "entity", 0.0), (1, "x", "other", 1.0), (1, None, "vec", 1.0), (2, "a", "vec", 0.5), (9, "a", "vec", 0.5), (1, "gone", "time", 0.7), (3, "a", "vec", None)]
    questions = [(1, "When did Anna leave"), (2, None), (3, "x")]
    entries = [("a", "Anna left last May", NOW), ("b", None, None), ("c", "x", NOW), ("d", "y", NOW)]
    make = spark.createDataFrame
    return (make(hits, "query_id int, id string, route string, score double"), make(questions, "query_id int, question string"), make(entries, "id string, text string, t timestamp_ntz"), make([("b2", "b")], "alias string, canonical string"))


def test_dialog_search(spark, parts):
    hits, questions, entries, aliases = parts
    got = {(r.query_id, r.id): r for r in R.dialog_search(hits, questions, entries, 5, {"recency": 0.1}, aliases=aliases, now=timestamp("2024-01-03")).collect()}
    # the alias's score counts for b; what has no positive score, no known route or question, or no id is gone; an unknown entry stays without a text
    assert sorted(got) == [(1, "a"), (1, "b"), (1, "gone"), (2, "a")]
    blend = lambda w, rank, norm: w * (0.7 / (60 + rank) + 0.3 * norm)
    name_and_time = 0.004 + 0.004
    assert got[1, "a"].preselect == pytest.approx(blend(0.6, 2, 0) + blend(0.15, 1, 1) + name_and_time + 0.1, abs=1e-8)
    assert got[1, "b"].preselect == pytest.approx(blend(0.6, 1, 1), abs=1e-8)
    assert got[1, "gone"].preselect == pytest.approx(blend(0.15, 2, 1), abs=1e-8) and got[1, "a"].routes == 2
    assert [got[1, i].rank for i in ("b", "a", "gone")] == [1, 2, 3]


def test_switches(spark, parts):
    hits, questions, entries, _ = parts
    run = lambda **o: {(r.query_id, r.id): r for r in R.dialog_search(hits, questions, entries, 5, {"recency": 0.1, "signal": 1.0}, now=timestamp("2024-01-03"), **o).collect()}
    assert (1, "gone") not in run(without=R.Ablation(["time"]))
    assert run(without=R.Ablation(list(R.ROUTE_NAMES))) == {}
    known = spark.createDataFrame([("a", 9, 1, 0, 2)], "id string, utterances int, knowledge int, entities int, slices int")
    full, off, untimed = (run(support=known, without=R.Ablation([], s))[1, "a"] for s in ([], ["graph_signal", "recency"], ["timestamp"]))
    assert full.signal == pytest.approx(0.9 + 0.4 + 0.2) and full.final == pytest.approx(full.selection + full.signal)
    assert off.signal == 0 and off.preselect == pytest.approx(full.preselect - 0.1)
    assert untimed.signal == pytest.approx(1.3) and untimed.preselect == pytest.approx(off.preselect)
    for bad in (["clock"], ["vec"]):
        with pytest.raises(ValueError):
            R.Ablation(bad)
    with pytest.raises(ValueError):
        R.Rerank("both")


def test_outside_scores(spark):
    rows = [(1, i, s) for i, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6))] + [(2, 1, 0.5)]
    c = spark.createDataFrame(rows, "query_id int, id int, preselect double")
    model = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.1), (1, 2, 0.4), (1, 4, 5.0)], "query_id int, id int, model double")
    run = lambda m, how: {(r.query_id, r.id): round(r.selection, 6) for r in R.reranked(c, m, how).collect()}
    assert run(model, R.Rerank("rerank_only", 3)) == {(1, 1): 0.0, (1, 2): 0.0, (1, 3): 1.0, (1, 4): 0.6, (2, 1): 1.0}
    assert run(model, R.Rerank("base_only", 3)) == {(1, 1): 1.0, (1, 2): 0.5, (1, 3): 0.0, (1, 4): 0.6, (2, 1): 1.0}
    flat = model.withColumn("model", F.lit(0.3))
    assert run(flat, R.Rerank("rerank_only", 3)) == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 0.5, (1, 4): 0.6, (2, 1): 1.0}
    assert run(model.limit(0), R.Rerank("blend", 2))[1, 1] == 0.25


def test_scopes(spark):
    rows = [(1, 1, 0.9, "b", "a"), (1, 2, 0.2, "a", "a"), (2, 1, 0.4, "b", "b"), (2, 2, 0.4, "b", "b"), (2, 3, 0.9, "c", "b"), (3, 1, 0.1, None, "z"), (3, 2, 0.2, "z", "z")]
    s = spark.createDataFrame(rows, "query_id int, id int, score double, domain string, q_domain string")
    q = s.select("query_id", "q_domain").distinct()
    run = lambda *o: sorted((r.query_id, r.id, r.scope) for r in R.scoped(s, q, [["domain"], []], 1, *o).collect())
    assert run() == [(1, 2, 0), (2, 1, 0), (3, 2, 0)]
    assert run(0.3) == [(1, 1, 1), (2, 1, 0)]
    assert run(0.3, True) == [(1, 1, 1), (2, 1, 0), (3, 2, 0)]


def test_hybrid_search_of_odd_rows(spark):
    make = spark.createDataFrame
    e = make([(1, [1.0, 0.0], "red fox", NOW, "u"), (2, [0.0, 1.0], None, None, None), (3, None, "red red", NOW, "v"), (4, [-1.0, 0.0], "", NOW, "u")], "id int, vector array<double>, text string, t timestamp_ntz, user string")
    q = make([(7, [1.0, 0.0], "Red", "u"), (8, [1.0, 0.0], None, "nobody")], "query_id int, qvec array<double>, text string, q_user string")
    edges = make([(1, 4, "co_occurs", 1.0)], "src_id int, dst_id int, rel_type string, weight double")
    run = lambda e, scopes: {(r.query_id, r.id): r for r in R.hybrid_search(q, e, edges, 5, scopes, timestamp("2024-01-03"), O.HybridWeights(user=0.5), hops=1).collect()}
    got = run(e, [["user"]])
    assert sorted(got) == [(7, 1), (7, 4)]  # entry 3 has the word, but is of another user; no scope serves the second query
    assert (got[7, 1].v, got[7, 1].b, got[7, 4].b) == (1.0, 1.0, 0.0) and got[7, 1].g == pytest.approx(0.4)
    assert got[7, 1].score == pytest.approx(0.6 + 0.25 + 0.04 + 0.05 + 0.5)
    wide = run(e, [[]])
    assert {i for n, i in wide if n == 7} == {i for n, i in wide if n == 8} == {1, 2, 3, 4}
    assert wide[7, 2].rec == 0 and wide[7, 3].b == 1.0 and all(wide[8, i].b == 0 for i in (1, 2, 3, 4))
    assert run(e.limit(0), [[]]) == {}
