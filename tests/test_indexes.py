"""Stored indexes of words and vectors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import scoring, text_index
from tidepool.operators.text_index import TextIndex, candidates, postings, words_of
from tidepool.operators.vector_index import VectorIndex
from tidepool.plans import registry
from tidepool.sources.store import new_path

TEXTS = [(1, "Red fish, blue fish"), (2, "the red_fox 42"), (3, None), (4, ""), (5, "红色的狐狸 fox"), (6, "狐"), (7, "red red red"), (None, "red lost"), (8, "fish " * 5000)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").withColumn("token", F.lit("x")).withColumn("shard", F.lit(1))


def test_words_are_those_of_the_column(spark, texts):
    for r in texts.select("text", scoring.bm25_tokens(F.col("text")).alias("w")).collect():
        assert words_of(r.text or "") == r.w
    got = Counter((r.id, r.dl, r.token, r.tf) for r in postings(texts).collect())
    assert got == Counter(x for i, t in TEXTS for w in [words_of(t or "")] for x in [*((i, len(w), k, n) for k, n in Counter(w).items()), (i, len(w), None, 0)])


def brute_bm25(docs, question):
    words = {i: words_of(t or "") for i, t in docs}
    mean, n = sum(map(len, words.values())) / len(words), len(words)
    out = Counter()
    for w, times in Counter(words_of(question)).items():
        df = sum(w in x for x in words.values())
        for i, x in words.items():
            if tf := x.count(w):
                out[i] += times * math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / mean))
    return out


def test_index_grows_by_segments(spark, texts, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", 8)
    q = spark.createDataFrame([(1, "red fish red"), (2, "nothing here"), (3, ""), (4, "狐狸 FOX")], "query_id long, text string")
    index.add(texts.filter("id < 5"))
    index.add(texts.filter("id >= 5 OR id IS NULL"))
    index.add(texts.limit(0))
    (tmp_path / "i" / "half").mkdir()  # a segment whose writer died
    got = {(r.query_id, r.id): r.score for r in index.bm25(q).collect()}
    want = {(k, i): s for k, t in [(1, "red fish red"), (4, "狐狸 FOX")] for i, s in brute_bm25(TEXTS, t).items()}
    assert got == pytest.approx(want)
    assert {(r.query_id, r.id) for r in index.having_all(q).collect()} == {(1, 1), (4, 5)}
    live = {(r.query_id, r.id): r.score for r in scoring.bm25(texts, q).collect()}
    assert live == pytest.approx(want)


def test_search_opens_only_the_asked_shards(spark, texts, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", 32)
    index.add(texts)
    words = spark.createDataFrame([("fish",)], "token string")
    found = index.of(words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0] and "fish" in plan.split("PushedFilters: [")[1].split("\n")[0]
    assert {(r.id, r.tf) for r in found.collect()} == {(1, 2), (8, 5000)}


def test_best_branch_of_an_event_counts(spark, tmp_path):
    rows = {"summary": [("a", "red fish")], "utterance": [("b", "fish red"), ("c", "red fish again")], "evidence": [("d", "a red fish"), ("e", "red")]}
    own = {"summary": [("a", 1, None)], "utterance": [("b", 1, "u"), ("c", 2, None)], "evidence": [("d", 1, "v"), ("e", 3, "w")]}
    indexes = {b: TextIndex(spark, f"file://{tmp_path}/{b}", 4) for b in rows}
    for b, r in rows.items():
        indexes[b].add(spark.createDataFrame(r, "id string, text string"))
    owners = {b: spark.createDataFrame(r, "id string, event_id long, source_id string") for b, r in own.items()}
    got = candidates(indexes, owners, spark.createDataFrame([(0, "RED fish")], "query_id int, text string"), 5).collect()
    assert [(r.event_id, r.score, r.source_id, r.branches) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1.0, "u", "evidence,summary,utterance"), (2, 0.8, None, "utterance")]


def test_candidates_in_cells_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(f"{e}-{t}", e if e % 13 else None, t if t % 3 else None, ["summary", "utterance", "evidence"][min(t, 2)], " ".join(rng.choice(vocabulary, rng.integers(0, 12), p=np.arange(40, 0, -1) / 820))) for e in range(300) for t in range(4)]
    asked = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 4)))) for i in range(200)] + [(900 + i, "w1 W0 w1") for i in range(30)] + [(950, "w0 nowhere")]
    want = []
    for q, question in asked:
        hits: dict = {}
        for _, e, t, branch, text in rows:
            if question.split() and {*words_of(question)} <= {*words_of(text)}:
                hits.setdefault(e, []).append((text_index.BRANCHES[branch], t, branch))
        best = sorted(((-max(s for s, _, _ in h), 1e9 if e is None else e), e, max(((s, t) for s, t, _ in h if t is not None), default=(0, None))[1], ",".join(sorted({b for _, _, b in h}))) for e, h in hits.items())[:5]
        want += [(q, e, -s, source, branches, n) for n, ((s, _), e, source, branches) in enumerate(best, 1)]
    made = {b: TextIndex(spark, new_path(spark, b), 4) for b in text_index.BRANCHES}
    for b in made:
        made[b].add(spark.createDataFrame([(i, x) for i, _, _, branch, x in rows if branch == b], "id string, text string"))
    owners = {b: spark.createDataFrame([(i, e, t) for i, e, t, branch, _ in rows if branch == b], "id string, event_id long, source_id int") for b in made}
    for sizes in ({}, {"PART": 150, "QUESTIONS": 40, "CHECKED": 50, "FREQUENT": 8}, {"FREQUENT": 1}):
        for name, size in sizes.items():
            monkeypatch.setattr(text_index, name, size)
        got = candidates(made, owners, spark.createDataFrame(asked, "query_id int, text string"), 5)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 300


def vectors(spark, n=3000, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.01 * rng.normal(size=(n // 3, dim))  # a third of all in one place
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [1.0, 2.0]), (n + 2, [0.0] * dim), (n + 3, []), (n + 4, x[5].tolist()), (n + 5, x[5].tolist())]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_lists_hold_every_vector_and_a_large_one_is_cut(spark):
    v = vectors(spark)
    index = VectorIndex(v, 16, lists=5, piece=100)
    assert sorted(r.id for r in index.rows.collect()) == list(range(3006)) and {k for k, _, _ in index.facts if k < 0} == {-1}
    sizes = [r["count"] for r in index.rows.groupBy("list", "piece").count().collect()]
    assert max(sizes) < 200 and max(index.pieces.values()) >= 5


def test_search_by_bounds_is_a_scan(spark):
    v = vectors(spark)
    index = VectorIndex(v, 16, piece=500)
    q = v.filter("id % 50 = 0 OR id >= 3000").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    want = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in scoring.cosine_top(q, v, 10).collect()}
    got = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in index.search_exact(q, 10, probes=2).collect()}
    assert {k: x for k, x in got.items() if k[0] < 3000} == {k: x for k, x in want.items() if k[0] < 3000}
    # bounds rule lists out
    assert index._probes(q.filter("query_id < 50"), 2, spark.createDataFrame([(0, 0.9)], "query_id long, least double")).count() < sum(index.pieces.values())


def test_an_index_of_nothing(spark):
    v = vectors(spark, 6).limit(0)
    index = VectorIndex(v, 16)
    q = spark.createDataFrame([(1, [1.0] * 16)], "query_id long, qvec array<double>")
    assert index.search(q, 3).count() == 0 and index.search_exact(q, 3).count() == 0 and index.probes_for(3) == 1


def test_recall_of_the_query(spark, sf):
    """ann_topk against the scan: nine of ten nearest are found."""
    exact = {(r.query_id, r.id) for r in registry.QUERIES["cosine_topk"](spark, sf).collect()}
    got = {(r.query_id, r.id) for r in registry.QUERIES["ann_topk"](spark, sf).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("sizes", [{}, {"PART": 3, "BLOCK": 2, "SCORES": 4}])
def test_postings_meet_queries_in_cells(spark, tmp_path, monkeypatch, sizes):
    """A posting is shuffled once for a block of queries, not for each query with its word, and no hit is shuffled; with k a cell gives few rows."""
    for name, n in sizes.items():
        monkeypatch.setattr(text_index, name, n)
    rows = TEXTS + [(2, "blue fox"), (None, "fish lost red"), (9, "red lost"), (10, "red lost"), (11, "red lost"), (12, "lost red"), (13, "of none")]
    index = TextIndex(spark, f"file://{tmp_path}/i", 4)
    texts = spark.createDataFrame(rows, "id long, text string")
    index.add(texts)
    asked = {1: "red fish red", 2: "nothing here", 4: "狐狸 FOX", 5: "lost", 6: "red lost", 7: "blue blue fox", None: "fish"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    words = {w for t in asked.values() for w in words_of(t)}
    one = Counter()
    for question, t in asked.items():
        mean = sum(len(words_of(x or "")) for _, x in rows) / len(rows)
        for w, times in Counter(words_of(t)).items():
            df = sum(w in words_of(x or "") for _, x in rows)
            for i, x in rows:
                if tf := words_of(x or "").count(w):
                    one[question, i] += times * math.log1p((len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words_of(x)) / mean))
    own = {i: set().union(*(words_of(x or "") for j, x in rows if j == i)) for i, _ in rows}
    assert words and {(r.query_id, r.id) for r in index.having_all(q).collect()} == {(k, i) for k, t in asked.items() for i, w in own.items() if {*words_of(t)} <= w}
    for found in (index.bm25(q), scoring.bm25(texts, q)):
        assert {(r.query_id, r.id): r.score for r in found.collect()} == pytest.approx(one)
    order = lambda r: (r[1] is not None, r[1] or 0)
    for k in (1, 2, 5):
        want = {(x, i) for x in asked for i in [i for _, i in sorted(((-round(s, 6), i) for (y, i), s in one.items() if y == x), key=lambda r: (r[0], order(r)))][:k]}
        for found in (index.bm25(q, k), scoring.bm25(texts, q, k)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0] and {(r.query_id, r.id) for r in scoring.top(found.withColumn("score", F.round("score", 6)), ["query_id"], k).collect()} == want
    if not sizes:
        assert index.bm25(q, 1).count() == len({x for x, _ in one})
