"""Pattern matches, expansion, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import seconds, timestamp
from ..operators import graph as G
from ..operators import intervals as I
from ..sources import tables as S
from .registry import query

INV = "inv AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem)"
PAIRS = "p AS (SELECT x.entity_id AS a, y.entity_id AS b, x.event_id FROM inv x JOIN inv y ON x.event_id = y.event_id AND x.entity_id < y.entity_id)"
EDGES = """e AS (SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, 'SUPPLIED_BY' AS rel_type, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN', 2.0 FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', 1.0 FROM customer)"""
SEEDS = ["p1", "p2", "p7", "c3"]


@query("rel_by_events", f"WITH {INV} SELECT i.entity_id, count(DISTINCT i.event_id) AS strength, min(o_orderdate) AS first_t, max(o_orderdate) AS last_t FROM inv i JOIN inv s ON s.event_id = i.event_id AND s.entity_id = 1 JOIN orders ON o_orderkey = i.event_id WHERE i.entity_id <> 1 GROUP BY 1 ORDER BY strength DESC, entity_id LIMIT 50")
def rel_by_events(spark: SparkSession, d: str) -> DataFrame:
    """The parts that are ordered most with part 1."""
    return G.relations_of(S.involves(spark, d), S.order_events(spark, d), 1).orderBy(F.desc("strength"), "entity_id").limit(50)


@query("cooccur_events", f"WITH {INV}, {PAIRS} SELECT a, b, count(DISTINCT event_id) AS weight, min(o_orderdate) AS first_t, max(o_orderdate) AS last_t FROM p JOIN orders ON o_orderkey = event_id GROUP BY a, b HAVING count(DISTINCT event_id) >= 2")
def cooccur_events(spark: SparkSession, d: str) -> DataFrame:
    return G.co_occurrence(S.involves(spark, d), S.order_events(spark, d), 2)


@query("cooccur_slices", """WITH s AS (SELECT DISTINCT date_trunc('hour', ts) AS slice, user_id FROM events) SELECT x.user_id AS a, y.user_id AS b, count(*) AS weight FROM s x JOIN s y ON x.slice = y.slice AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def cooccur_slices(spark: SparkSession, d: str) -> DataFrame:
    """Users active in the same hours."""
    s = S.parquet(spark, d, "events", "ts", "user_id").select(F.date_trunc("hour", "ts").alias("event_id"), F.col("user_id").alias("entity_id"))
    return G.shared_events(s, 3)


@query("first_meetings_all", f"WITH {INV}, {PAIRS}, r AS (SELECT a, b, event_id, o_orderdate AS t, o_custkey, row_number() OVER (PARTITION BY a, b ORDER BY o_orderdate, event_id) AS k FROM p JOIN orders ON o_orderkey = event_id) SELECT a, b, event_id, t, CAST(c_nationkey AS BIGINT) AS place_id FROM r LEFT JOIN customer ON c_custkey = o_custkey WHERE k = 1")
def first_meetings_all(spark: SparkSession, d: str) -> DataFrame:
    return G.first_meetings(S.involves(spark, d), S.order_events(spark, d), S.occurs_at(spark, d)).select("a", "b", "event_id", "t", "place_id")


@query("first_meeting_pair", f"WITH {INV}, {PAIRS} SELECT event_id, o_orderdate AS t FROM p JOIN orders ON o_orderkey = event_id WHERE (a, b) = (SELECT (a, b) FROM p ORDER BY a, b LIMIT 1) ORDER BY t, event_id LIMIT 1")
def first_meeting_pair(spark: SparkSession, d: str) -> DataFrame:
    inv = S.involves(spark, d)
    # the first entity that has a companion, then its first companion: no pairs are made
    first = inv.groupBy("event_id").agg(F.min("entity_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.min("a").alias("a"))
    beside = inv.join(inv.join(F.broadcast(first), F.col("entity_id") == F.col("a")).select("event_id", "a"), "event_id").filter("entity_id > a")
    second = beside.agg(F.min("entity_id").alias("b"))
    own = beside.join(F.broadcast(second), F.col("entity_id") == F.col("b")).join(S.order_events(spark, d).select(F.col("id").alias("event_id"), "t"), "event_id")
    return own.select("event_id", "t").orderBy("t", "event_id").limit(1)


@query("events_full", """WITH i AS (SELECT l_orderkey AS event_id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS entities FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, o_orderdate AS t, coalesce(entities, '') AS entities, n_name AS place FROM orders LEFT JOIN i ON event_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P' ORDER BY t, event_id LIMIT 100""")
def events_full(spark: SparkSession, d: str) -> DataFrame:
    """Events with their entities and place."""
    e = S.order_events(spark, d).filter("status = 'P'").select(F.col("id").alias("event_id"), "t").orderBy("t", "event_id").limit(100)
    places = S.occurs_at(spark, d).join(S.places(spark, d).select(F.col("id").alias("place_id"), "name"), "place_id").select("event_id", F.col("name").alias("item"))
    out = G.bundle(e, {"entities": S.involves(spark, d).select("event_id", F.col("entity_id").cast("string").alias("item")), "place": places})
    return out.select("event_id", "t", F.array_join("entities", ",").alias("entities"), F.get("place", F.lit(0)).alias("place"))


@query("explain_bundle", """WITH p AS (SELECT l_orderkey AS event_id, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS entities, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS evidences, count(DISTINCT l_shipdate) AS slices FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, coalesce(entities, '') AS entities, coalesce(evidences, '') AS evidences, coalesce(slices, 0) AS slices, CAST(round(0.3 * least(coalesce(slices, 0), 3) + 0.2 * least(CASE WHEN entities IS NULL THEN 0 ELSE len(string_split(entities, ',')) END, 3), 6) AS DOUBLE) AS signal FROM orders LEFT JOIN p ON event_id = o_orderkey""")
def explain_bundle(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import explain_signal

    e = S.order_events(spark, d).select(F.col("id").alias("event_id"))
    lines = S.parquet(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").withColumnRenamed("l_orderkey", "event_id")
    # all branches come from one table, so from one aggregate of it
    ids = lambda letter, c: F.sort_array(F.collect_set(F.concat(F.lit(letter), F.col(c).cast("string"))))
    own = lines.groupBy("event_id").agg(ids("p", "l_partkey").alias("entities"), ids("s", "l_suppkey").alias("evidences"), F.collect_set("l_shipdate").alias("slices"))
    out = e.join(own, "event_id", "left").withColumns({c: F.coalesce(c, F.array().cast(own.schema[c].dataType)) for c in ("entities", "evidences", "slices")})
    signal = explain_signal(F.size("slices"), F.lit(0), F.size("entities"), F.lit(0))
    return out.select("event_id", F.array_join("entities", ",").alias("entities"), F.array_join("evidences", ",").alias("evidences"), F.size("slices").cast("long").alias("slices"), F.round(signal, 6).alias("signal"))


@query("events_by_ids", "SELECT event_id AS id, ts AS t FROM events WHERE event_id IN (5, 3, 99, 1000) AND ts >= TIMESTAMP '2024-01-01'")
def events_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.in_order(S.events(spark, d).select("id", "t"), [5, 3, 99, 5, 1000]).filter(F.col("t") >= timestamp("2024-01-01")).select("id", "t")


@query("entities_in_order", "SELECT c_custkey AS id, c_name AS name, CASE c_custkey WHEN 9 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS pos FROM customer WHERE c_custkey IN (9, 2, 5)")
def entities_in_order(spark: SparkSession, d: str) -> DataFrame:
    c = S.parquet(spark, d, "customer", "c_custkey", "c_name").toDF("id", "name")
    return G.in_order(c, [9, 2, 9, 5]).select("id", "name", "pos").orderBy("pos")


@query("logical_id_latest", "SELECT o_custkey AS logical_id, max(o_orderdate) AS t, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def logical_id_latest(spark: SparkSession, d: str) -> DataFrame:
    o = S.order_events(spark, d).withColumnRenamed("actor_id", "logical_id")
    return o.groupBy("logical_id").agg(F.max("t").alias("t"), F.max_by("id", F.struct("t", "id")).alias("id"))


@query("entity_by_name", "SELECT p_partkey AS id, p_name AS name, CAST(CASE WHEN lower(p_name) = 'red widget' THEN 1.0 WHEN contains(lower(p_name), 'red widget') THEN 0.8 ELSE 0.6 END AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'red widget') OR levenshtein(lower(p_name), 'red widget') <= 2 ORDER BY score DESC, id LIMIT 20")
def entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    p = S.parquet(spark, d, "part", "p_partkey", "p_name").toDF("id", "name")
    return G.resolve_names(p, "Red Widget").select("id", "name", "score").orderBy(F.desc("score"), "id").limit(20)


@query("entity_facts", "SELECT p_partkey AS entity_id, l_orderkey AS fact_id, max(l_shipdate) AS t, count(*) AS sources FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY t DESC, fact_id, entity_id LIMIT 100")
def entity_facts(spark: SparkSession, d: str) -> DataFrame:
    """What is stated of entities, newest first."""
    lines = S.parquet(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate")
    return lines.groupBy(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("fact_id")).agg(F.max("l_shipdate").alias("t"), F.count(F.lit(1)).alias("sources")).orderBy(F.desc("t"), "fact_id", "entity_id").limit(100)


@query("entity_timeline_union", "SELECT o_custkey AS entity_id, 'order' AS kind, o_orderkey AS item, o_orderdate AS t FROM orders UNION ALL SELECT user_id, event_type, event_id, ts FROM events")
def entity_timeline_union(spark: SparkSession, d: str) -> DataFrame:
    a = S.order_events(spark, d).select(F.col("actor_id").alias("entity_id"), F.lit("order").alias("kind"), F.col("id").alias("item"), "t")
    b = S.events(spark, d).select(F.col("user_id").alias("entity_id"), F.col("action").alias("kind"), F.col("id").alias("item"), "t")
    return a.unionByName(b)


@query("places_by_time", "SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name, count(*) AS visits, min(o_orderdate) AS first_t FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1, 2")
def places_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = S.order_events(spark, d).filter(F.col("t").between(timestamp("1997-01-01"), timestamp("1997-12-31"))).select(F.col("id").alias("event_id"), "t")
    at = e.join(S.occurs_at(spark, d), "event_id").groupBy("place_id").agg(F.count(F.lit(1)).alias("visits"), F.min("t").alias("first_t"))
    return at.join(S.places(spark, d).select(F.col("id").alias("place_id"), "name"), "place_id").select("place_id", "name", "visits", "first_t")


@query("place_detail", "SELECT n_name AS name, count(DISTINCT c_custkey) AS entities, count(o_orderkey) AS events, round(sum(o_totalprice), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_nationkey = 3 GROUP BY 1")
def place_detail(spark: SparkSession, d: str) -> DataFrame:
    c = S.parquet(spark, d, "customer", "c_custkey", "c_nationkey").filter("c_nationkey = 3")
    o = S.parquet(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    n = S.parquet(spark, d, "nation", "n_nationkey", "n_name").filter("n_nationkey = 3")
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return j.groupBy(F.col("n_name").alias("name")).agg(F.count_distinct("c_custkey").alias("entities"), F.count("o_orderkey").alias("events"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("place_hierarchy", "WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, r_name AS path, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, t.path || '/' || n_name, t.depth + 1 FROM t JOIN nation ON t.id = 'r' || n_regionkey) SELECT * FROM t")
def place_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Paths from regions down; each level is a join."""
    top = S.parquet(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("path"), F.lit(0).alias("depth"))
    n = S.parquet(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nid"), "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id"))
    down = top.join(n, "id").select(F.col("nid").alias("id"), F.concat_ws("/", "path", "n_name").alias("path"), (F.col("depth") + 1).alias("depth"))
    return top.unionByName(down)


HOP = "u AS (SELECT src_id, dst_id, rel_type, weight FROM e UNION ALL SELECT dst_id, src_id, rel_type, weight FROM e)"
H1 = "h1 AS (SELECT s.seed, u.dst_id AS t, u.rel_type, u.weight, 1 AS hop FROM s JOIN u ON u.src_id = s.seed WHERE u.dst_id <> s.seed)"
H2 = "h2 AS (SELECT f.seed, u.dst_id AS t, u.rel_type, u.weight, 2 AS hop FROM (SELECT DISTINCT seed, t FROM h1) f JOIN u ON u.src_id = f.t WHERE u.dst_id <> f.seed)"
PICK = "r AS (SELECT *, row_number() OVER (PARTITION BY seed, t ORDER BY weight DESC, hop, rel_type) AS k FROM {0}), c AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, hop, t) AS n FROM r WHERE k = 1) SELECT seed, t AS \"to\", rel_type AS rel, weight, hop FROM c WHERE n <= 25"
SEED_SQL = "s AS (SELECT unnest(['p1', 'p2', 'p7', 'c3']) AS seed)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "seed string")


@query("expand_hop1", f"WITH {EDGES}, {HOP}, {SEED_SQL}, {H1}, {PICK.format('h1')}")
def expand_hop1(spark: SparkSession, d: str) -> DataFrame:
    return G.expand(S.edges(spark, d), _seeds(spark), 1, 25)


@query("expand_hop2", f"WITH {EDGES}, {HOP}, {SEED_SQL}, {H1}, {H2}, {PICK.format('(SELECT * FROM h1 UNION ALL SELECT * FROM h2)')}")
def expand_hop2(spark: SparkSession, d: str) -> DataFrame:
    return G.expand(S.edges(spark, d), _seeds(spark), 2, 25)


@query("expand_hop2_directed", f"WITH {EDGES}, u AS (SELECT * FROM e WHERE rel_type IN ('SUPPLIED_BY', 'BASED_IN')), {SEED_SQL}, {H1}, {H2}, {PICK.format('(SELECT * FROM h1 UNION ALL SELECT * FROM h2)')}")
def expand_hop2_directed(spark: SparkSession, d: str) -> DataFrame:
    return G.expand(S.edges(spark, d), _seeds(spark), 2, 25, directed=True, relations=["supplied_by", "based_in"])


@query("find_paths", f"WITH {EDGES}, g AS (SELECT * FROM e WHERE weight >= 1) SELECT 1 AS hops, dst_id AS via, dst_id AS \"to\", weight FROM g WHERE src_id = 'p1' UNION ALL SELECT 2, x.dst_id, y.dst_id, x.weight * y.weight FROM g x JOIN g y ON x.dst_id = y.src_id WHERE x.src_id = 'p1' AND y.dst_id <> 'p1'")
def find_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.paths(S.edges(spark, d), "p1", 1.0)


@query("orphan_entities", f"WITH {EDGES}, n AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'x' || n_nationkey FROM nation) SELECT id FROM n WHERE id NOT IN (SELECT src_id FROM e UNION ALL SELECT dst_id FROM e)")
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    n = S.parquet(spark, d, "part", "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    n = n.unionByName(S.parquet(spark, d, "nation", "n_nationkey").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("id")))
    return G.orphans(n, S.edges(spark, d))


TRACKS = "tr AS (SELECT user_id, event_id AS id, (epoch_us(ts) - 1704067200000000) / 1e6 AS s, (epoch_us(ts) - 1704067200000000) / 1e6 + value AS f FROM events)"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    s = seconds(F.col("t"), timestamp("2024-01-01"))
    return S.events(spark, d).select("user_id", "id", "action", s.alias("start"), (s + F.col("value")).alias("end"))


@query("interval_overlap_pairs", f"WITH {TRACKS} SELECT x.id AS a, y.id AS b, floor((least(x.f, y.f) - greatest(x.s, y.s)) * 1000 + 0.5) / 1000 AS seconds FROM tr x JOIN tr y ON x.user_id < y.user_id AND x.s < y.f AND y.s < x.f")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = I.overlap_pairs(_tracks(spark, d).select("id", F.col("user_id").alias("key"), "start", "end"), 600.0)
    return pairs.select("a", "b", (F.floor(F.col("overlap") * 1000 + 0.5) / 1000).alias("seconds"))


@query("timeslice_overlap", "SELECT n AS slice, count(*) AS events FROM (SELECT unnest(range(0, 30)) AS n) JOIN events ON ts <= TIMESTAMP '2024-01-01' + (n + 1) * INTERVAL 1 DAY AND ts + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-01' + n * INTERVAL 1 DAY GROUP BY 1")
def timeslice_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Events by the daily slices that they touch, bounds included."""
    s = seconds(F.col("t"), timestamp("2024-01-01"))
    e = S.events(spark, d).select("id", s.alias("a_start"), (s + 3600).alias("a_end"))
    n = spark.range(30).select(F.col("id").alias("slice"), (F.col("id") * 86400.0).alias("b_start"), ((F.col("id") + 1) * 86400.0).alias("b_end"))
    return I.overlap_join(e, n, 86400.0, bounds="closed").groupBy("slice").agg(F.count(F.lit(1)).alias("events"))


@query("span_to_segment", f"WITH {TRACKS}, g AS (SELECT unnest(range(CAST(floor(min(s) / 900) AS BIGINT), CAST(floor(max(f) / 900) AS BIGINT) + 1)) AS i FROM tr) SELECT id AS span_id, min(i) AS segment_index FROM tr JOIN g ON s < (i + 1) * 900 AND i * 900 < f GROUP BY 1")
def span_to_segment(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d)
    g = t.agg(F.floor(F.min("start") / 900).alias("first"), F.floor(F.max("end") / 900).alias("last")).select(F.explode(F.sequence("first", "last")).alias("segment_index"))
    g = g.select("segment_index", (F.col("segment_index") * 900.0).alias("start"), ((F.col("segment_index") + 1) * 900.0).alias("end"))
    return I.assign_first(t.select(F.col("id").alias("span_id"), "start", "end"), g, 900.0)


@query("nearest_sample", f"WITH {TRACKS}, c AS (SELECT id, user_id, s FROM tr WHERE id % 2 = 0), o AS (SELECT id, user_id, s FROM tr WHERE id % 2 = 1), r AS (SELECT c.id AS point_id, o.id AS sample_id, c.user_id, row_number() OVER (PARTITION BY c.id ORDER BY abs(c.s - o.s), o.s) AS k FROM c JOIN o USING (user_id)) SELECT user_id, point_id, sample_id FROM r WHERE k = 1")
def nearest_sample(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d)
    return I.nearest(t.filter("id % 2 = 0").select("user_id", F.col("id").alias("point_id"), F.col("start").alias("at")), t.filter("id % 2 = 1").select("user_id", F.col("id").alias("sample_id"), F.col("start").alias("t")), ["user_id"]).filter("sample_id IS NOT NULL")
