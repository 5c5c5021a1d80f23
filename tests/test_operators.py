"""Operators on small hand-made rows: the cases that large tables don't have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool import schema
from tidepool.functions import text as T
from tidepool.functions.literals import timestamp
from tidepool.operators import derive, evaluate, filters, graph, intervals, maintain, scoring, state
from tidepool.streaming import ingest


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_schemas_are_valid(spark):
    for label in ("event", "entity", "place", "time_slice", "media_segment", "evidence", "utterance", "region", "state", "pending_state", "knowledge"):
        assert "tenant_id" in schema.node_schema(label).names
    assert "weight" in schema.edge_schema().names and "contents" in schema.entry_schema().names
    assert all(len(v) == 2 for v in schema.RELATIONS.values())


def test_visibility(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, NULL, NULL), (2, TIMESTAMP_NTZ '2024-01-01', true), (3, TIMESTAMP_NTZ '2024-03-01', NULL), (4, NULL, false) AS t(id, expires_at, published)")
    assert values(rows.filter(filters.visible(timestamp("2024-02-01"))), "id") == [(1,), (3,)]
    assert values(rows.filter(filters.published_is(True)), "id") == [(1,), (2,), (3,)]
    assert values(rows.filter(filters.published_is(False)), "id") == [(4,)]


def test_users_match_null_and_empty(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, array('a','b')), (2, array()), (3, CAST(NULL AS ARRAY<STRING>)), (4, array('a')) AS t(id, user_id)")
    assert values(rows.filter(filters.users_match(["a", "b"])), "id") == [(1,), (4,)]
    assert values(rows.filter(filters.users_match(["a", "b"], "all")), "id") == [(1,)]


def test_ladder_and_threshold(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id int, score double")
    assert values(filters.ladder(rows, [F.col("id") > 5, F.col("id") == 2, F.lit(True)]), "id", "scope_rank") == [(2, 1)]
    assert filters.at_least(rows, 0.9, False).count() == 0 and filters.at_least(rows, 0.9, True).count() == 2
    assert values(filters.at_least(rows, 0.3, True), "id") == [(2,)]
    assert filters.ladder(rows.limit(0), [F.lit(True)]).count() == 0


def test_state_chain_ties_and_current(spark):
    o = spark.sql("SELECT * FROM VALUES ('a', 1, 'x', TIMESTAMP_NTZ '2024-01-01'), ('a', 2, 'x', TIMESTAMP_NTZ '2024-01-02'), ('a', 3, 'y', TIMESTAMP_NTZ '2024-01-03'), ('a', 4, NULL, TIMESTAMP_NTZ '2024-01-03') AS t(k, id, value, t)")
    c = state.chain(o, ["k"])
    assert [r.value for r in c.orderBy("source_event_id").collect()] == ["x", "y", None]
    assert values(state.current(c, ["k"]), "source_event_id") == [(4,)]
    assert values(state.as_of(c, ["k"], timestamp("2024-01-02 12:00:00")), "value") == [("x",)]


def test_overlap_join_bounds(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 20.0)], "i int, a_start double, a_end double")
    b = spark.createDataFrame([(9, 10.0, 12.0), (8, 3.0, 4.0)], "j int, b_start double, b_end double")
    assert values(intervals.overlap_join(a, b, 5.0), "i", "j") == [(1, 8), (2, 9)]
    assert values(intervals.overlap_join(a, b, 5.0, bounds="closed"), "i", "j") == [(1, 8), (1, 9), (2, 9)]


def test_islands(spark):
    s = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 3.0), ("a", 10.5, 11.0), ("a", 20.0, 21.0)], "k string, start double, end double")
    assert values(intervals.islands(s, ["k"], 1.0), "start", "end", "spans") == [(0.0, 11.0, 3), (20.0, 21.0, 1)]


def test_expand_prefers_strong_edges_and_caps(spark):
    e = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 5.0), ("a", "c", "R", 2.0), ("c", "a", "S", None)], "src_id string, dst_id string, rel_type string, weight double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r.to: (r.weight, r.hop) for r in graph.expand(e, seeds, 2, 10).collect()}
    assert got == {"b": (5.0, 2), "c": (5.0, 2)}
    assert graph.expand(e, seeds, 2, 1).count() == 1
    assert {r.to for r in graph.expand(e, seeds, 1, 10, directed=True, relations=["r"]).collect()} == {"b", "c"}


def test_cosine_edge_cases(spark):
    v = spark.sql("SELECT * FROM VALUES (1, array(1.0, 0.0), array(1.0, 0.0)), (2, array(0.0, 0.0), array(1.0, 0.0)), (3, array(1.0), array(1.0, 0.0)) AS t(id, a, b)")
    assert values(v.select("id", scoring.cosine(F.col("a"), F.col("b")).alias("s")), "id", "s") == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_bm25_tokens_mixed_scripts(spark):
    t = spark.createDataFrame([("Hello 世界你 A_1",), ("",), (None,), ("界",)], "text string")
    assert [r[0] for r in t.select(scoring.bm25_tokens(F.col("text"))).collect()] == [["hello", "世界", "界你", "a_1"], [], [], ["界"]]


def test_question(spark):
    asked = [(1, "When did Caroline go to the adoption meeting?"), (2, "Is her husband at the sunrise"), (3, ""), (4, None), (5, "What is the relationship status"), (6, "what books")]
    q = spark.createDataFrame(asked, "id int, question string").select("id", scoring.profile(F.col("question")).alias("q"))
    p = {r.id: r.q for r in q.collect()}
    assert p[1].slot == "time" and p[1].names == ["caroline"] and "adoption meeting" in p[1].phrases and "go to" not in p[1].phrases
    assert p[1].anchors == ["go", "the", "adoption", "meeting"] and p[1].rare == ["adoption", "meeting"]
    assert sorted(p[2].rivals) == ["sunset", "wife"] and [p[i].slot for i in range(2, 7)] == ["general", "general", "general", "status", "list"]
    assert all(not p[i][k] for i in (3, 4) for k in ("tokens", "names", "anchors", "rare", "phrases", "rivals"))
    texts = [(1, "Caroline went to an adoption meeting on 7 May 2023"), (1, "Melanie stayed"), (2, "My wife saw the sunset"), (3, "Melanie"), (4, "x"), (1, None), (1, "")]
    t = spark.createDataFrame(texts, "id int, text string").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = [round(r[1], 6) for r in sorted(t.join(q, "id").select("n", scoring.fidelity(F.col("q"), F.col("text"))).collect())]
    # a name, two words, both long, one phrase, a time; another name; one word against two rivals; nothing to meet
    assert got == [0.004 + 0.003 + 0.002 + 0.003 + 0.004, -0.004, round(0.0015 - 0.004, 6), 0, 0, 0, 0]


def test_names_and_times(spark):
    row = spark.range(1).select(
        T.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("python.org")).alias("u"), T.turn_number(F.lit("D8:6")).alias("n"), T.duration_seconds(F.lit("7d")).alias("d"), T.duration_seconds(F.lit("x")).alias("e"),
        T.shortened(F.lit("a" * 300), 200).alias("s"), T.chat_time(F.lit("1:56 pm on 8 May, 2023")).cast("string").alias("t"), T.topic_token(F.lit(" My-Topic  name! ")).alias("k"),
    ).first()
    assert (row.u, row.n, row.d, row.e, len(row.s)) == ("886313e1-3b8a-5372-9b90-0c9aee199e5d", 6, 604800.0, None, 200)
    assert row.t == "2023-05-08 13:56:00" and row.k == "my_topic_name"


def test_time_window():
    now = dt.datetime(2024, 5, 15, 13)
    assert T.time_window("what happened yesterday?", now) == (dt.datetime(2024, 5, 14), dt.datetime(2024, 5, 15))
    assert T.time_window("on 2023-02-03", now)[0] == dt.datetime(2023, 2, 3)
    assert T.time_window("last month", now) == (dt.datetime(2024, 4, 1), dt.datetime(2024, 5, 1))
    assert T.time_window("who?", now) is None


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        scoring.HybridWeights(vector=0.9)


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    new = spark.createDataFrame([(2, None, "z"), (3, "n", None)], "id int, x string, y string")
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    assert sorted(map(tuple, maintain.upsert(old, new, ["id"]).collect()), key=key) == [(1, "a", "b"), (2, None, "z"), (3, "n", None)]
    assert sorted(map(tuple, maintain.upsert(old, new, ["id"], merge_nulls=True).collect()), key=key) == [(1, "a", "b"), (2, "c", "z"), (3, "n", None)]


def test_metrics(spark):
    p = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, id string, rank int")
    g = spark.createDataFrame([("q", "a"), ("q", "z")], "query_id string, id string")
    assert values(evaluate.precision_recall(p, g, 3), "precision", "recall") == [(0.5, 0.5)]
    assert values(evaluate.weighted_support(p, g), "support") == [(0.5,)]
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    assert values(evaluate.accuracy(p, g, queries, 1), "accuracy") == [(0.5,)]


def test_session_graph(spark):
    t = spark.createDataFrame([(1, 0, "anna", "Hi Ben"), (1, 1, "ben", "Hi"), (2, 0, "anna", "Bye")], "session_id long, idx long, speaker string, text string")
    m = spark.createDataFrame([(1, 0, "Ben")], "session_id long, idx long, entity string")
    tables = derive.build_session_graph(t, m)
    assert values(tables["edge"].groupBy("rel_type").count(), "rel_type", "count") == [("CONTAINS", 3), ("MENTIONS", 1), ("NEXT_EVENT", 1), ("SPOKEN_BY", 3)]
    assert values(tables["entity"], "name") == [("Anna",), ("Ben",)]


def test_streams_match_batch(spark, tmp_path):
    obs = spark.sql("SELECT * FROM VALUES ('k', 'a', TIMESTAMP '2024-01-01'), ('k', 'b', TIMESTAMP '2024-01-03'), ('k', 'b', TIMESTAMP '2024-01-04') AS t(key, value, t)")
    late = spark.sql("SELECT * FROM VALUES ('k', 'c', TIMESTAMP '2024-01-02'), ('j', 'x', TIMESTAMP '2024-01-02') AS t(key, value, t)")
    for i, part in enumerate((obs, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    ingest.run_to_end(ingest.state_changes(ingest.source(spark, str(tmp_path / "in"), obs, files=2)), str(tmp_path / "cp1"), lambda b, n: out.extend(b.collect()))
    assert {(r.key, r.value) for r in out if r.status == "applied"} >= {("k", "a"), ("k", "b"), ("j", "x")}
    once = []
    turns = spark.createDataFrame([("s", "c1"), ("s", "c1"), ("s", "c2")], "session_id string, commit_id string")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    ingest.run_to_end(ingest.commits_once(ingest.source(spark, str(tmp_path / "turns"), turns), ["session_id", "commit_id"]), str(tmp_path / "cp2"), lambda b, n: once.extend(b.collect()))
    assert sorted(r.commit_id for r in once) == ["c1", "c2"]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_media_folds(spark):
    from tidepool.operators import media

    pairs = spark.createDataFrame([(1, "a", "x", 0.9, False), (1, "a", "y", 0.8, True), (1, "b", "x", 0.7, False), (2, "a", "x", 0.1, False)], "source_id int, speaker string, track string, score double, verified boolean")
    assert values(media.match_once(pairs), "source_id", "speaker", "track") == [(1, "a", "y"), (1, "b", "x"), (2, "a", "x")]
    tracks = spark.createDataFrame([(1, 1, 0.0, 1.0, [1.0, 0.0]), (1, 2, 10.0, 11.0, [0.9, 0.1]), (1, 3, 20.0, 21.0, [0.0, 1.0]), (1, 4, 22.0, 23.0, [1.0, 0.0])], "seed int, track int, start double, end double, embedding array<double>")
    assert values(media.stitch(tracks), "start", "end", "tracks") == [(0.0, 11.0, 2), (20.0, 23.0, 2)]
    faces = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.9, 30.0), (1, 2, [1.0, 0.1], 0.9, 30.0), (1, 3, [0.0, 1.0], 0.9, 30.0), (1, 4, [1.0, 0.0], 0.1, 30.0)], "source_id int, id int, embedding array<double>, detection_confidence double, quality_score double")
    assert values(media.similar_faces(faces, 0.9), "id", "cluster") == [(1, 1), (2, 1), (3, 3), (4, -1)]


def test_alignment_picks_the_closest_turns(spark):
    from tidepool.operators import media

    turns = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in (0, 5, 6, 7)] + [(1, 3, [0.0, 1.0])], "session_id int, idx int, vector array<double>")
    events = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [-1.0, -1.0])], "session_id int, event_id int, vector array<double>")
    got = {r.event_id: (r.hits, r.status, r.first, r.last) for r in media.align(turns, events).collect()}
    assert got == {1: (4, "mapped", 5, 7), 2: (1, "weak", 3, 3), 3: (0, "unmapped", None, None)}


def test_client(spark, tmp_path):
    from tidepool.client import Memory

    m = Memory(spark, str(tmp_path / "store"))
    m.add(spark.createDataFrame([("1", "t", "red widget in the box"), ("2", "t", "blue ring"), ("1", "u", "red ring")], "id string, tenant_id string, text string"))
    assert [r.id for r in m.search("t", "red").collect()] == ["1"]
    m.update("t", "2", "red red ring")
    assert {r.id for r in m.search("t", "red").collect()} == {"1", "2"}
    m.delete("t", "1")
    assert [r.id for r in m.search("t", "red").collect()] == ["2"] and m.get("t", "1").count() == 0
    assert [r.event for r in m.history("t", "1").collect()] == ["ADD", "DELETE"]
    m.clear("t")
    assert values(m.entries(), "tenant_id", "id") == [("u", "1")]


def test_client_decides_and_rolls_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidepool.client import Memory

    def decide(old, new):
        return new.withColumn("decision", F.when(F.col("text") == "forget", "DELETE").when(F.col("text") == "same", "NONE").otherwise("UPDATE"))

    kinds = "id string, tenant_id string, text string"
    m = Memory(spark, str(tmp_path / "store"), decide)
    m.add(spark.createDataFrame([("1", "t", "one"), ("2", "t", "two"), ("3", "t", "three"), ("1", "u", "one")], kinds))
    m.add(spark.createDataFrame([("1", "t", "forget"), ("2", "t", "same"), ("3", "t", "four")], kinds))
    assert values(m.entries().filter("NOT is_deleted"), "tenant_id", "id", "text") == [("t", "2", "two"), ("t", "3", "four"), ("u", "1", "one")]
    assert [r.event for r in m.history("t", "1").collect()] == ["ADD", "DELETE"]
    for key in ("1", "3"):
        m.rollback("t", key, m.history("t", key).collect()[-1].seq)
    assert values(m.entries().filter("NOT is_deleted"), "tenant_id", "id", "text") == [("t", "1", "one"), ("t", "2", "two"), ("t", "3", "three"), ("u", "1", "one")]
    m.rollback("t", "2", m.history("t", "2").collect()[0].seq)
    assert m.get("t", "2").count() == 0 and m.history("t", "2").collect()[-1].event == "ROLLBACK"


def test_client_keeps_changes_of_two_writers(spark, tmp_path):
    """A second writer commits between the first one's reading and writing: both changes are there, each logged once."""
    from pyspark.sql import functions as F

    from tidepool.client import Conflict, Memory

    kinds, path = "id string, tenant_id string, text string", str(tmp_path / "store")
    other, late = Memory(spark, path), []

    def decide(old, new):
        if late:
            other.add(spark.createDataFrame([(late.pop(), "t", "from the other")], kinds))
        return new.withColumn("decision", F.lit("UPDATE"))

    m = Memory(spark, path, decide)
    m.add(spark.createDataFrame([("1", "t", "one"), ("9", "u", "theirs")], kinds))
    late.append("2")
    m.add(spark.createDataFrame([("3", "t", "three"), ("3", "t", "three again"), (None, "t", "x"), ("4", None, "x")], kinds))
    assert [(r.tenant_id, r.id) for r in m.entries().orderBy("tenant_id", "id").collect()] == [("t", "1"), ("t", "2"), ("t", "3"), ("u", "9")]
    assert sorted((r.object_id, r.seq, r.event) for r in m.audit().filter("tenant_id = 't'").collect()) == [("1", 1, "ADD"), ("2", 2, "ADD"), ("3", 3, "ADD")] and m.commits("u") == [1]
    # nothing to change is no commit; old tables can go, the log stays
    m.delete("t", "none")
    assert m.commits("t") == [1, 2, 3] and m.vacuum("t") == 2 and m.of("t").count() == 3 and m.audit().count() == 4
    # a writer that never gets a number gives up
    late[:] = [str(i) for i in range(100, 200)]
    import tidepool.client

    tries, tidepool.client.TRIES = tidepool.client.TRIES, 2
    try:
        with pytest.raises(Conflict):
            m.add(spark.createDataFrame([("5", "t", "five")], kinds))
    finally:
        tidepool.client.TRIES = tries
    assert m.get("t", "5").count() == 0


def test_client_finds_by_vector(spark, tmp_path):
    from tidepool.client import Memory

    m = Memory(spark, str(tmp_path / "store"))
    m.add(spark.createDataFrame([("1", "t/ä", "a", [1.0, 0.0]), ("2", "t/ä", "b", [0.6, 0.8]), ("3", "t/ä", "c", None), ("4", "u", "d", [1.0, 0.0])], "id string, tenant_id string, text string, vector array<float>"))
    assert [(r.id, round(r.score, 5)) for r in m.near("t/ä", [0.0, 2.0], 3).orderBy("rank").collect()] == [("2", 0.8), ("1", 0.0), ("3", 0.0)]
    m.update("t/ä", "2", "bb")
    m.rollback("t/ä", "2", 2)
    assert [(r.text, len(r.vector)) for r in m.get("t/ä", "2").collect()] == [("b", 2)]


def test_upsert_of_repeated_keys(spark):
    from tidepool.operators import maintain

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (3, "z")], "id long, v string")
    for order in (new, new.orderBy("v"), new.orderBy("v", ascending=False)):
        assert maintain.upsert(old, order, ["id"]).count() == 3 and len({tuple(r) for r in maintain.upsert(old, order, ["id"]).collect()}) == 3
    assert {r.v for r in maintain.unique(new.withColumn("t", F.when(F.col("v") == "x", 2).otherwise(1)), ["id"], "t").filter("id = 2").collect()} == {"x"}


def test_equivalences_are_approved_and_rejected(spark):
    from tidepool.operators import maintain

    edges = spark.createDataFrame([("a", "b", "EQUIV", 0.4), ("d", "c", "EQUIV", 0.7), ("a", "c", "KNOWS", 2.0), ("x", "y", "EQUIV", None)], "src_id string, dst_id string, rel_type string, weight double")
    pending = spark.createDataFrame([("b", "a", "approved"), ("c", "d", "rejected"), ("e", "f", "approved"), ("f", "e", "approved"), ("g", "h", "pending"), ("i", "j", "approved"), ("j", "i", "rejected"), ("k", "k", "approved")], "a string, b string, status string")
    got = {(r.src_id, r.dst_id, r.rel_type, r.weight) for r in maintain.approve_equivalents(edges, pending).collect()}
    assert got == {("a", "b", "EQUIV", 0.4), ("a", "c", "KNOWS", 2.0), ("e", "f", "EQUIV", 1.0), ("x", "y", "EQUIV", None)}


def test_purge_takes_orphans_of_orphans(spark):
    from tidepool.operators import maintain

    nodes = spark.createDataFrame([("v1", "Event"), ("v2", "Event"), ("e1", "Entity"), ("e2", "Entity"), ("p1", "Place"), ("q1", "Region"), ("lone", "Entity")], "id string, label string")
    edges = spark.createDataFrame([("v1", "e1", "INVOLVES", 1.0), ("v1", "e2", "INVOLVES", 1.0), ("v2", "e2", "INVOLVES", 1.0), ("e1", "p1", "LIVES", 1.0), ("p1", "q1", "IN", 1.0)], "src_id string, dst_id string, rel_type string, weight double")
    left, kept, went = maintain.purge(nodes, edges, spark.createDataFrame([("v1",), ("unknown",)], "id string"), ["Entity", "Place"])
    assert {(r.id, r["round"]) for r in went.collect()} == {("v1", 0), ("e1", 1), ("p1", 2)} and {r.id for r in left.collect()} == {"v2", "e2", "q1", "lone"}
    assert {(r.src_id, r.dst_id) for r in kept.collect()} == {("v2", "e2")}
    _, _, went = maintain.purge(nodes, edges, spark.createDataFrame([("v1",), ("p1",)], "id string"), ["Entity", "Place"], directed=False)
    assert {(r.id, r["round"]) for r in went.collect()} == {("v1", 0), ("p1", 0), ("e1", 1)}


def test_cosine_top_in_blocks(spark):
    from tidepool.operators import scoring

    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame(rows[:9], "query_id long, qvec array<double>")
    want = sorted(map(tuple, scoring.cosine_top(asked, corpus, 3).collect()))
    assert sorted(map(tuple, scoring.cosine_top(asked, corpus, 3, block=2).collect())) == want and len(want) == 27


def test_percentiles_of_many_values(spark):
    import numpy as np

    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 30_011 / 3 + F.when(F.col("id") % 5 == 0, 10_000).otherwise(0)).alias("v"))
    own = {k: np.sort(g.v.to_numpy()) for k, g in rows.toPandas().groupby("k")}
    points = [0.0, 0.25, 0.8, 0.999, 1.0]
    for r in derive.percentiles(rows, ["k"], "v", points).collect():
        assert [r[f"p{round(p * 100)}"] for p in points[:3]] == pytest.approx(list(np.quantile(own[r.k], points[:3])))
    got = {(r.k, p): r.value for p in points for r in derive.nearest_rank(rows, ["k"], "v", p).collect()}
    assert got == {(k, p): x[int(np.rint(p * (len(x) - 1)))] for k, x in own.items() for p in points}
    some = spark.createDataFrame([(1, None), (2, 3.0), (2, 3.0), (2, None)], "k int, v double")
    assert {r.k: r.p50 for r in derive.percentiles(some, ["k"], "v", [0.5]).collect()} == {1: None, 2: 3.0}


def test_sessions_of_two_batches(spark, tmp_path):
    write, kinds = ingest.replace_sessions(str(tmp_path / "sessions")), "session_id int, idx int, text string"
    second = spark.createDataFrame([(1, 1, "b2"), (1, 2, "c")], kinds)
    write(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x")], kinds), 0)
    for _ in range(2):
        write(second, 1)
    assert values(spark.read.parquet(str(tmp_path / "sessions")), "session_id", "idx", "text") == [(1, 0, "a"), (1, 1, "b2"), (1, 2, "c"), (2, 0, "x")]
