"""Steps that must stay bounded, and roundings that SQL fixes."""

from itertools import combinations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidepool.operators import graph, intervals, maintain
from tidepool.plans import registry
from tidepool.sources import store, tables


def test_shared_events_in_blocks(spark):
    rows = [(e, p) for e in range(40) for p in range(30) if (e * 7 + p * 5) % 11 < 4] + [(None, 1), (3, None), (1, 2), (1, 2)]
    i = spark.createDataFrame(rows, "event_id int, entity_id long")
    of: dict = {}
    for e, p in rows:
        if e is not None and p is not None:
            of.setdefault(p, set()).add(e)
    want = sorted((a, b, len(of[a] & of[b])) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= 3)
    for block in (None, 7):
        out = graph.shared_events(i, 3, block)
        assert sorted(map(tuple, out.collect())) == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert not graph.shared_events(i.limit(0)).collect()


def test_event_repair_rounds_as_its_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{d}/orders.parquet')")
    want = c.execute(f"SELECT event_id, confidence FROM ({registry.ORACLES['event_repair']}) ORDER BY 1").fetchall()
    got = registry.QUERIES["event_repair"](spark, d).select("event_id", F.col("confidence")).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == want


def test_pairs_have_partitions_by_their_count(spark, monkeypatch):
    i = spark.createDataFrame([(e, p) for e in range(50) for p in range(e % 9)], "event_id int, entity_id long")
    want = sorted((e, a, b) for e in range(50) for a, b in combinations(range(e % 9), 2))
    for size, pairs in ((10**6, 1), (100, -(-len(want) // 100))):
        monkeypatch.setattr(graph, "ROWS", size)
        out = graph.pairs_in_events(i)
        assert out.rdd.getNumPartitions() == pairs and sorted((r.event_id, r.a, r.b) for r in out.collect()) == want
    assert not graph.pairs_in_events(i.limit(0)).collect()


def test_lines_have_partitions_by_their_count(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for size, n in ((10**6, spark.sparkContext.defaultParallelism), (100, -(-lines // 100))):
        monkeypatch.setattr(tables, "ROWS", size)
        for made in (tables.involves(spark, sf), tables.edges(spark, sf).filter("rel_type = 'SUPPLIED_BY'")):
            assert made.rdd.getNumPartitions() == n and made.count() == made.distinct().count()


def test_purge_stores_edges_once(spark, monkeypatch):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    pairs = chain + [(f"k{i % 3}", f"k{(i + 1) % 3}") for i in range(300)] + [("c3", "z"), ("k0", "z"), ("c2", "c2"), ("x", "c5"), ("c4", "w"), ("c4", "w"), ("u", "u"), (None, "c9"), ("c0", "y"), ("y", "c0")]
    ids = sorted({x for p in pairs for x in p if x and x != "x"} | {"lone"})
    nodes = spark.createDataFrame([(i, "Region" if i == "y" else "Entity") for i in ids], "id string, label string")
    edges = spark.createDataFrame([(a, b, "R") for a, b in pairs], "src_id string, dst_id string, rel_type string")
    for directed, doomed in ((True, ["c0"]), (False, ["c2", "y"]), (True, ["c2", "c4", "none"]), (True, [])):
        rows = []

        def counted(df, name, rows=rows):
            out = store.stored(df, name)
            rows.append(out.count())
            return out

        monkeypatch.setattr(maintain, "stored", counted)
        want, gone, left = {(i, 0) for i in doomed if i in ids}, {*doomed}, pairs
        for n in range(1, 20):
            cut = {b for a, b in left if a in gone} | (set() if directed else {a for a, b in left if b in gone})
            left = [(a, b) for a, b in left if a not in gone and b not in gone]
            held = {b for _, b in left} | (set() if directed else {a for a, _ in left})
            new = {i for i in ids if i != "y" and i in cut and i not in held and i not in gone}
            want, gone = want | {(i, n) for i in new}, gone | new
        kept, rest, went = maintain.purge(nodes, edges, spark.createDataFrame([(i,) for i in doomed], "id string"), ["Entity"], directed)
        assert {(r.id, r["round"]) for r in went.collect()} == want and {r.id for r in kept.collect()} == {*ids} - gone
        assert sorted((r.src_id or "", r.dst_id) for r in rest.collect()) == sorted((a or "", b) for a, b in left)
        assert sum(x for x in rows if x >= 250) <= len(pairs) * (1 if directed else 2)


def test_overlap_pairs_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at = np.round(np.r_[rng.uniform(0, 40, 60), rng.uniform(20, 21, 60), np.repeat(25.0, 8)], 1).tolist()
    rows = [(i, int(rng.integers(0, 9)), s, s + n) for i, (s, n) in enumerate(zip(at, [*np.round(rng.exponential(4, 125), 1).tolist(), 0.0, -3.0, 0.0]))]
    rows += [(900, None, 20.0, 30.0), (901, 3, None, 30.0), (902, 3, 20.0, None), rows[5], rows[70]]
    full = [r for r in rows if None not in r]
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in full for y in full if x[1] < y[1] and x[2] < y[3] and y[2] < x[3])
    t = spark.createDataFrame(rows, "id long, key int, start double, end double")
    for sizes, width in (({}, 5.0), ({"PIECE": 300, "DEALT": 100, "MADE": 7}, 5.0), ({"MOST_PIECED": 0}, 2.5)):
        for name, size in sizes.items():
            monkeypatch.setattr(intervals, name, size)
        got = sorted(map(tuple, intervals.overlap_pairs(t, width).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    words = t.select(F.concat(F.lit("e"), "id").alias("id"), F.col("key").cast("string"), "start", "end")
    assert sorted((r.a, r.b) for r in intervals.overlap_pairs(words, 5.0).collect()) == sorted((f"e{a}", f"e{b}") for a, b, _ in want)
    assert not intervals.overlap_pairs(t.limit(0), 5.0).collect()


def test_overlap_pairs_are_small_in_files(spark, tmp_path):
    # every row overlaps a few hundred others, as where many users act at a time
    rng = np.random.default_rng(5)
    rows = [(10**6 + i, int(u), float(s), float(s + n)) for i, (u, s, n) in enumerate(zip(rng.permutation(3000), rng.uniform(0, 1200, 3000), np.round(rng.exponential(50, 3000), 2)))]
    d = str(tmp_path / "t")
    spark.createDataFrame(rows, "event_id long, user_id long, s double, value double").select("event_id", (F.timestamp_micros((F.lit(1704067200) + F.col("s")).cast("long") * 1000000)).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), (F.col("value") - F.col("s")).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{d}/events.parquet")
    out = registry.QUERIES["interval_overlap_pairs"](spark, d)
    out.write.parquet(str(tmp_path / "out"))
    columns = {}
    for f in (tmp_path / "out").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            for c in map(m.row_group(g).column, range(2)):
                columns[c.path_in_schema] = columns.get(c.path_in_schema, 0) + c.total_compressed_size
    assert out.count() > 200_000 and sum(columns.values()) < 1.3 * out.count()


def test_shared_events_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets = {f"n{i}": {int(e) for e in rng.integers(0, 40, rng.integers(1, 12))} for i in range(90)}
    sets |= {f"m{i}": sets["n3"] for i in range(40)}
    i = spark.createDataFrame([(e, p) for p, own in sets.items() for e in own], "event_id int, entity_id string").repartition(5)
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2)
    monkeypatch.setattr(graph, "WIDE", 4)
    monkeypatch.setattr(graph, "COUNTED", 20)
    for block in (200, 30):
        assert sorted(map(tuple, graph.shared_events(i, 2, block).collect())) == want


def test_shared_events_are_small_in_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    sets = [np.flatnonzero(rng.random(200) < 0.2).tolist() for _ in range(24)]
    rows = [(e, p) for p in range(2400) for e in sets[p % 24]]
    out = graph.shared_events(spark.createDataFrame(rows, "event_id int, entity_id long"), 3)
    out.write.parquet(str(tmp_path / "out"))
    pairs = spark.read.parquet(str(tmp_path / "out")).count()
    assert pairs > 2_000_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.7 * pairs
