"""Stitching, dialogue graphs, repairs, names and times: the cases that large tables don't have."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions.literals import timestamp
from tidepool.operators import dialog, intervals, media, names, repair, retrieval
from tidepool.plans import registry


def brute_stitch(rows, least=0.75, gap=2.0):
    out = []
    for seed in sorted({r[0] for r in rows}):
        now = None
        for _, _, start, end, v in sorted((r for r in rows if r[0] == seed), key=lambda r: (r[2], r[3], r[1])):
            v = np.asarray(v, float)
            if now:
                m = now["sum"] / now["n"]
                if start - now["end"] <= gap or (m @ v) / (np.linalg.norm(m) * np.linalg.norm(v)) >= least:
                    now |= {"sum": now["sum"] + v, "n": now["n"] + 1, "end": max(now["end"], end)}
                    continue
            now = {"seed": seed, "start": start, "end": end, "sum": v, "n": 1}
            out.append(now)
    return sorted((o["seed"], o["start"], o["end"], o["n"]) for o in out)


@pytest.mark.parametrize("width", [3.0, 20.0, 10_000.0])
def test_stitching_in_blocks_is_one_fold(spark, width):
    """Blocks of any width, also where a tracklet goes through several and a first state changes what follows."""
    rng = random.Random(4)
    rows = []
    for seed in range(4):
        t, angle = 0.0, 0.0
        for k in range(80):
            t += rng.choice([0.5, 1.0, 4.0, 9.0])
            angle += rng.choice([0.0, 0.2, 0.6, 1.5])
            rows.append((seed, k, t, t + rng.choice([0.2, 3.0]), [float(np.cos(angle)), float(np.sin(angle))]))
    got = media.stitch(spark.createDataFrame(rows, "seed long, track long, start double, end double, embedding array<double>"), width=width)
    assert sorted((r.seed, r.start, r.end, r.tracks) for r in got.collect()) == brute_stitch(rows)
    assert sorted(r.part for r in got.filter("seed = 0").collect()) == list(range(got.filter("seed = 0").count()))


def test_tracklets_of_the_query(spark, sf):
    v = pd.read_parquet(f"{sf}/embeddings.parquet")
    rows = [(r.label, r.vec_id, r.vec_id * 3.0, r.vec_id * 3.0 + 2, r.embedding) for r in v.itertuples()]
    got = registry.QUERIES["tracklet_stitch"](spark, sf).collect()
    assert sorted((r.seed, r.start, r.end, r.tracks) for r in got) == brute_stitch(rows)


def test_dialogue_graph_of_odd_rows(spark):
    turns = spark.createDataFrame([("s", 0, " Ann  Lee "), ("s", 1, None), ("s", 1, None), (None, 2, "x"), ("t", 0, "ann lee")], "session_id string, idx long, speaker string")
    events = spark.createDataFrame([("s", 0, [0, 1, 7], ["ANN LEE", " ", "Bo"], "Rome"), ("s", 4, None, None, None), (None, 1, [0], ["x"], "y")], "session_id string, n long, turn_idx array<long>, participants array<string>, place string")
    facts = spark.createDataFrame([("s", 0, [0], [1, 9], None, ["Bo"])], "session_id string, k long, events array<long>, turn_idx array<long>, speaker string, about array<string>")
    edges = dialog.dialog_edges(turns, events, facts)
    got = {(r.src_id, r.dst_id, r.rel_type) for r in edges.collect()}
    assert len(got) == edges.count() and ("event|s|0", "event|s|4", "NEXT_EVENT") in got and ("fact|s|0", "utterance|s|1", "SUPPORTED_BY") in got and ("utterance|t|0", "entity|ann lee", "SPOKEN_BY") in got
    assert {d for s, d, r in got if s == "event|s|0" and r == "INVOLVES"} == {"entity|ann lee", "entity|bo"} and {d for s, d, r in got if s == "event|s|0" and r == "SUPPORTED_BY"} == {"utterance|s|0", "utterance|s|1"}
    ids = spark.createDataFrame([("event|s|0",), ("event|s|4",), ("event|none",), ("event|s|0",)], "id string")
    b = {r.id: r for r in dialog.event_bundle(edges, ids).collect()}
    assert len(b) == 3 and b["event|s|0"].knowledge == ["fact|s|0"] and b["event|s|0"].speakers == ["entity|ann lee"] and b["event|s|4"].slices == ["slice|s"] and b["event|none"].entities == []
    hidden = spark.createDataFrame([("fact|s|0",), ("utterance|s|0",)], "id string")
    assert dialog.event_bundle(edges, ids, hidden).filter("id = 'event|s|0'").first().asDict() | {"knowledge": [], "speakers": [], "utterances": ["utterance|s|1"]} == dialog.event_bundle(edges, ids, hidden).filter("id = 'event|s|0'").first().asDict()


def test_routes_of_a_dialogue(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], ["entity|a", "entity|b", "entity|a"], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)), (2, None, None, None, None)], "query_id long, qvec array<double>, people array<string>, t_from timestamp_ntz, t_to timestamp_ntz")
    e = spark.createDataFrame([("e1", [1.0, 0.1], dt.datetime(2024, 1, 2)), ("e2", [0.0, 1.0], dt.datetime(2024, 1, 3)), ("e3", None, None)], "id string, vector array<double>, t timestamp_ntz")
    u = spark.createDataFrame([("u1", [0.9, 0.1]), ("u2", [0.8, 0.2]), ("u3", [1.0, 0.0])], "id string, vector array<double>")
    edges = spark.createDataFrame([("e3", "u1", "SUPPORTED_BY"), ("e3", "u2", "SUPPORTED_BY"), ("gone", "u3", "SUPPORTED_BY"), ("u2", "e2", "DERIVED_FROM"), ("e1", "entity|a", "INVOLVES"), ("e1", "entity|b", "INVOLVES"), ("e2", "entity|b", "INVOLVES")], "src_id string, dst_id string, rel_type string")
    got = {(r.query_id, r.route, r.id): r.score for r in retrieval.dialog_routes(q, e, u, u.filter("id = 'u2'"), edges, 5).collect() if r.query_id == 1}
    assert {k[1:] for k in got} == {("event_vec", "e1"), ("event_vec", "e2"), ("vec", "e3"), ("knowledge", "e2"), ("entity", "e1"), ("entity", "e2"), ("time", "e1"), ("time", "e2")}
    assert got[1, "entity", "e1"] == 1.0 and got[1, "entity", "e2"] == 0.5 and got[1, "time", "e1"] == 1.0 and got[1, "time", "e2"] == 0.5 and got[1, "vec", "e3"] > 0.99
    off = retrieval.Ablation(["event", "evidence", "knowledge", "entity", "time"])
    assert retrieval.dialog_routes(q, e, u, u, edges, 5, without=off).count() == 0


def test_repairs_of_nothing_and_repeats(spark):
    turns = spark.createDataFrame([("t1", "tool", "hello"), ("t1", "tool", "hello"), ("t2", None, None)], "turn_id string, role string, text string")
    kinds = "mark_id int, turn_id string, keep boolean, span_start int, span_end int, category string, subtype string, evidence_level string, importance string, saved boolean, status string"
    got = {r.mark_id: r for r in repair.marks(spark.createDataFrame([(1, "t1", True, 0, 5, " FACT ", None, None, "0.95", None, None), (2, None, None, None, None, None, None, None, None, None, None), (3, "t2", False, 0, 1, "odd", None, None, "-1", True, "done")], kinds), turns).collect()}
    assert len(got) == 3 and got[1].errors == [] and (got[1].category, got[1].subtype, got[1].evidence_level, got[1].forget_policy) == ("fact", "profile", "S2_tool_grounded", "permanent")
    assert got[2].errors == ["unknown_turn_id", "keep_invalid"] and not got[2].keep_row and got[2].importance == 0.5
    assert got[3].errors == ["span_range", "importance_range"] and (got[3].keep, got[3].importance, got[3].ttl_seconds, got[3].span_start) == (True, 0.9, 0, None)
    events = spark.createDataFrame([(1, "s", None, None, None, None), (2, None, "Composite", "weak", 2.0, ["t2", " t1 ", "t9"])], "event_id int, summary string, event_type string, status string, confidence double, turn_ids array<string>")
    got = {r.event_id: r for r in repair.events(events, turns).collect()}
    assert got[1].status == "unmapped" and got[1].errors == [] and got[2].turn_ids == ["t2", "t1"] and got[2].errors == ["summary_missing", "unknown_turns", "confidence_range"] and got[2].confidence == 1.0


def test_names_near_and_tied(spark):
    known = spark.createDataFrame([("home_city",), ("Home-City",), ("home",), ("mood",), ("moods today",), ("",), ("mood",)], "name string")
    alias = spark.createDataFrame([("feeling", "mood"), ("ghost", "unknown")], "alias string, name string")
    texts = spark.createDataFrame([(1, "mood"), (2, " Feeling "), (3, "feeling"), (4, "HOME city"), (5, "moo"), (6, None), (7, "ghost"), (8, "maad"), (9, "ome")], "id int, text string")
    got = {r.id: (r.matched, r.ambiguous, r.canonical, r.candidates, r.source) for r in names.resolve(texts, known, alias).collect()}
    assert got[1] == (True, False, "mood", [], "canonical_exact") and got[2] == (True, False, "mood", [], "normalized_alias") and got[3][4] == "alias_exact"
    assert got[4] == (False, True, None, ["Home-City", "home_city"], "normalized_match") and got[5] == (False, True, None, ["mood", "moods today"], None)
    assert got[6] == got[7] == got[8] == (False, False, None, [], None) and got[9][3] == ["home", "Home-City", "home_city"]
    near = {r.id: r.candidates for r in names.resolve(texts, known, alias, edits=2).collect()}
    assert near[8] == ["mood"] and near[5] == ["mood", "moods today"] and near[1] == []


def test_times_in_texts(spark):
    cases = [("between 2024-02-10 and 2024-2-8", (8, 2, 11, 2)), ("2024-02-30", None), ("on 2024-02-29.", (29, 2, 1, 3)), ("2024-02", (1, 2, 1, 3)), ("今天", (13, 3, 14, 3)), ("this week", (11, 3, 18, 3)), ("room 2024-02-111", None), (None, None), ("", None), ("call 20241", None)]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "id int, t string")
    got = {r.id: r.r for r in df.select("id", T.time_range(F.col("t"), timestamp("2024-03-13 10:00:00")).alias("r")).collect()}
    for n, (text, want) in enumerate(cases):
        have = got[n] and (got[n].start.day, got[n].start.month, got[n].end.day, got[n].end.month)
        assert have == want, text


def test_windows_that_grow(spark):
    media_ = spark.createDataFrame([(1, 5.0), (2, 300.0), (3, 10_000.0), (4, 0.0), (5, None), (6, 194.0)], "id int, duration double")
    got = intervals.adaptive(media_, 8.0, 2.0).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("end").alias("end")).collect()
    assert {r.id: (r.n, r.size, r.end) for r in got} == {1: (1, 8.0, 5.0), 2: (30, 11.0, 300.0), 3: (527, 20.0, 10_000.0), 4: (1, 8.0, 8.0), 5: (1, 8.0, 8.0), 6: (32, 8.0, 194.0)}
