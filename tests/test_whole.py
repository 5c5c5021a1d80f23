"""Queries over rows that an id, a user or a fixed range would leave out, against brute force."""

import datetime as dt
import math
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidepool.plans import registry

START = dt.datetime(2024, 1, 1)
#: id, seconds after START, user, action, length: ids from 2000, users from 20 and days after the 31st among others.
EVENTS = [(1, 100.0, 3, "click", 50.0), (2, 120.0, 13, "view", 60.0), (2001, 130.0, 23, "view", 500.0), (2002, 150.0, 33, "click", 300.0), (2003, 400.0, 43, "purchase", 100.0),
          (5000, 40 * 86400.0, 53, "view", 90.0), (5001, 40 * 86400.0 + 30, 53, "click", 200.0), (5002, 41 * 86400.0 - 10, 54, "view", 60.0), (5003, 41 * 86400.0 + 10, 64, "error", 5.0)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    ids, at, users, actions, lengths = zip(*EVENTS)
    events = {"event_id": ids, "ts": pa.array([START + dt.timedelta(seconds=s) for s in at], pa.timestamp("us")), "user_id": users, "event_type": actions, "value": lengths, "props": ['{"k": 1}'] * len(ids)}
    pq.write_table(pa.table(events), d / "events.parquet")
    return str(d)


def got(spark, name, d):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, d).collect())


def turns():
    """(source, id, action, start, end), and which overlap: even ids speak, odd ones are seen or heard."""
    m = [(u % 10, i, action, s, s + n) for i, s, u, action, n in EVENTS]
    return m, [(x, y) for x in m for y in m if x[0] == y[0] and x[1] % 2 == 0 and y[1] % 2 == 1 and x[3] < y[4] and y[3] < x[4]]


def test_face_voice_pairs_and_matches_of_all_events(spark, tables):
    pairs = {}
    for x, y in turns()[1]:
        if (o := min(x[4], y[4]) - max(x[3], y[3])) >= 0.4:
            pairs.setdefault((x[0], f"{x[2]}{x[0]}", y[2]), []).append((o, x[4] - x[3]))
    most = {k[:2]: max(len(v) for q, v in pairs.items() if q[:2] == k[:2]) for k in pairs}
    want = [(*k, round(sum(o for o, _ in v), 6), round(0.75 * min(1, sum(o for o, _ in v) / sum(n for _, n in v)) + 0.25 * len(v) / most[k[:2]], 6)) for k, v in pairs.items()]
    found = got(spark, "face_voice_pairs", tables)
    assert len(want) > 3 and [r[:3] for r in found] == sorted(r[:3] for r in want)
    assert [x for r in found for x in r[3:]] == pytest.approx([x for r in sorted(want) for x in r[3:]], abs=1e-5)
    matches, left, right = [], set(), set()
    for source, speaker, track, _, score in sorted(found, key=lambda r: (r[0], -r[4], r[1], r[2])):
        if (source, speaker) not in left and (source, track) not in right:
            matches.append((source, speaker, track, score))
            left.add((source, speaker))
            right.add((source, track))
    assert got(spark, "greedy_match", tables) == sorted(matches)


def test_window_payload_of_all_events_and_days(spark, tables):
    want = []
    for source in {x[0] for x in turns()[0]}:
        for n in range(60):
            items = sorted((x[3], x[1]) for x in turns()[0] if x[0] == source and n * 86400 <= x[4] and x[3] <= (n + 1) * 86400)
            want += [(source, n, ",".join(str(i) for _, i in items[:5]))] if items else []
    assert max(n for _, n, _ in want) == 41 and got(spark, "window_payload", tables) == sorted(want)


def test_speech_turns_of_all_events(spark, tables):
    m, pairs = turns()
    micros = lambda s: round(s * 1e6)
    want = [(x[0], x[2], str(y[1]), micros(max(x[3], y[3])), micros(min(x[4], y[4]))) for x, y in pairs]
    met = {(x[0], x[2], x[3]) for x, _ in pairs}
    want += [(x[0], x[2], "(audio)", micros(x[3]), micros(max(x[4], x[3] + 1))) for x in m if x[1] % 2 == 0 and (x[0], x[2], x[3]) not in met]
    assert got(spark, "speech_turns", tables) == sorted(want)


def test_interval_overlap_pairs_of_all_users(spark, tables):
    e = [(i, u, s, s + n) for i, s, u, _, n in EVENTS]
    want = [(x[0], y[0], round(min(x[3], y[3]) - max(x[2], y[2]), 3)) for x in e for y in e if x[1] < y[1] and x[2] < y[3] and y[2] < x[3]]
    assert any(a > 5000 for a, _, _ in want) and got(spark, "interval_overlap_pairs", tables) == sorted(want)


def test_span_to_segment_of_all_users_and_days(spark, tables):
    assert got(spark, "span_to_segment", tables) == sorted((i, int(s // 900)) for i, s, _, _, _ in EVENTS)


def test_nearest_sample_of_all_users(spark, tables):
    want = []
    for i, s, u, _, _ in EVENTS:
        samples = sorted((abs(s - t), t, j) for j, t, v, _, _ in EVENTS if v == u and j % 2 == 1)
        want += [(u, i, samples[0][2])] if i % 2 == 0 and samples else []
    assert want == [(53, 5000, 5001)] and got(spark, "nearest_sample", tables) == want


def test_proper_names_of_every_turn(spark, tmp_path):
    texts = ["Anna Lee met Bob", "Élodie saw Anna Lee – then André and Zoé", "nobody", "Naïve Karl Marx lives in Köln", "在London Paris 见面", "Straße: Maria, Jo", None]
    pq.write_table(pa.table({"conv_id": [1] * len(texts), "turn": range(len(texts)), "role": ["user"] * len(texts), "text": texts}), tmp_path / "conversations.parquet")
    want = [(1, i, ",".join(re.findall(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b", t)) if t is not None else None) for i, t in enumerate(texts)]
    assert got(spark, "proper_names", str(tmp_path)) == want


@pytest.fixture(scope="module")
def whole(sf):
    return lambda t: pq.read_table(f"{sf}/{t}.parquet").to_pylist()


def grouped(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return out


def test_explain_bundle_of_every_order(spark, sf, whole):
    lines = grouped((x["l_orderkey"], x) for x in whole("lineitem"))
    names = lambda own, letter, c: sorted({f"{letter}{x[c]}" for x in own})
    want = []
    for o in sorted(x["o_orderkey"] for x in whole("orders")):
        own = lines.get(o, [])
        p, s, n = names(own, "p", "l_partkey"), names(own, "s", "l_suppkey"), len({x["l_shipdate"] for x in own})
        want.append((o, ",".join(p), ",".join(s), n, round(0.3 * min(n, 3) + 0.2 * min(len(p), 3), 6)))
    assert len(want) > 1000 and got(spark, "explain_bundle", sf) == want


def test_entity_timeline_union_of_every_entity(spark, sf, whole):
    want = [(x["o_custkey"], "order", x["o_orderkey"], x["o_orderdate"]) for x in whole("orders")] + [(x["user_id"], x["event_type"], x["event_id"], x["ts"]) for x in whole("events")]
    assert got(spark, "entity_timeline_union", sf) == sorted(want)


def test_entity_facts_of_every_part(spark, sf, whole):
    facts = grouped(((x["l_partkey"], x["l_orderkey"]), x["l_shipdate"]) for x in whole("lineitem"))
    newest = sorted(((*k, max(v), len(v)) for k, v in facts.items()), key=lambda r: (-r[2].timestamp(), r[1], r[0]))[:100]
    assert got(spark, "entity_facts", sf) == sorted(newest)


def test_quotes_of_every_session(spark, tmp_path):
    pq.write_table(pa.table({"conv_id": [3, 20, 700, 701], "turn": [0, 1, 2, 3], "role": ["user", "user", "user", "assistant"], "text": ["a", "b", "c", "d"]}), tmp_path / "conversations.parquet")
    assert got(spark, "quotes", str(tmp_path)) == [(3, 0, "a"), (20, 1, "b"), (700, 2, "c")]


def test_semantic_summary_of_every_user(spark, sf, whole):
    users = grouped((x["user_id"], x) for x in whole("events"))
    ids = lambda own: ",".join(map(str, sorted(x["event_id"] for x in own if x["event_type"] in ("click", "view")))) or None
    assert got(spark, "semantic_summary", sf) == sorted((u, ids(own), sum(x["event_type"] == "purchase" for x in own)) for u, own in users.items())


def test_order_consistency_of_every_event(spark, tmp_path):
    pq.write_table(pa.table({"event_id": [1, 2, 400, 401], "ts": pa.array([START + dt.timedelta(days=i) for i in range(4)], pa.timestamp("us")), "user_id": [7, 8, 7, 9], "event_type": ["view"] * 4, "value": [5.0, 1.0, 4.0, 2.0], "props": ['{"k": 1}'] * 4}), tmp_path / "events.parquet")
    assert got(spark, "order_consistency", str(tmp_path)) == [(7, 0), (8, 1), (9, 1)]


def test_edge_endpoints_of_every_part(spark, sf, whole):
    parts, suppliers = {x["p_partkey"] for x in whole("part")}, {x["s_suppkey"] for x in whole("supplier")}
    want = {(f"p{x['l_partkey']}", f"s{x['l_suppkey']}") for x in whole("lineitem") if x["l_partkey"] in parts and x["l_suppkey"] in suppliers}
    assert got(spark, "edge_endpoints", sf) == sorted(want)


def test_bm25_topk_of_every_benchmark_item(spark, tmp_path):
    docs, items = ["red stone river", "blue stone", "green hill and river river", "hill"], ["stone", "river", "hill", "nothing", "red", "river hill hill", "blue"]
    pq.write_table(pa.table({"doc_id": range(len(docs)), "text": docs}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": range(len(items)), "text": items}), tmp_path / "benchmark.parquet")
    words, want = [x.split() for x in docs], []
    mean = sum(map(len, words)) / len(words)
    for q, item in enumerate(items):
        scores = []
        for i, own in enumerate(words):
            parts = [math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in item.split() if (n := sum(w in x for x in words)) and w in own]
            scores += [(-round(sum(parts), 6), i)] if parts else []
        want += [(q, i, -s, k) for k, (s, i) in enumerate(sorted(scores), 1)]
    found = got(spark, "bm25_topk", str(tmp_path))
    assert [(q, i, k) for q, i, _, k in found] == [(q, i, k) for q, i, _, k in sorted(want)] and [r[2] for r in found] == pytest.approx([r[2] for r in sorted(want)], abs=1e-5)


def test_event_candidates_of_every_conversation(spark, tmp_path):
    said = [(1, 0, "user", "Red fish swim, and more"), (1, 1, "assistant", "swim fish red"), (2, 0, "user", "red FISH swim"), (2, 1, "user", "no"), (50, 0, "user", "blue"), (51, 0, "user", ""), (53, 1, "user", "blue red fish swim"), (None, 0, "user", "blue")]
    c, t, r, x = zip(*said)
    pq.write_table(pa.table({"conv_id": pa.array(c, pa.int64()), "turn": pa.array(t, pa.int64()), "role": r, "text": x}), tmp_path / "conversations.parquet")
    rank = {"summary": 1.0, "utterance": 0.8, "evidence": 0.6}
    want = []
    for q, turn, _, text in said:
        words, hits = {*text.lower().replace(",", "").split()[:3]}, {}
        for e, n, role, other in said if q is not None and turn == 0 and words else ():
            if words <= {*other.lower().replace(",", "").split()}:
                hits.setdefault(e, []).append(("summary" if n == 0 else "utterance" if role == "user" else "evidence", n))
        best = sorted((-max(rank[b] for b, _ in h), 1e9 if e is None else e, e, max(((rank[b], n) for b, n in h if n % 3), default=(0, None))[1], ",".join(sorted({b for b, _ in h}))) for e, h in hits.items())
        want += [(q, e, -s, source, branches, n) for n, (s, _, e, source, branches) in enumerate(best, 1)]
    found = registry.QUERIES["event_candidates"](spark, str(tmp_path)).collect()
    assert {r[0] for r in want} == {1, 2, 50} and sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
