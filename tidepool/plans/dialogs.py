"""Conversations as graphs, and bundles of what the graph knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import timestamp
from ..operators import dialog as O
from ..operators import profiles as P
from ..sources import tables as S
from .registry import query

#: Three turns make an event; every second has a participant besides the speakers and a place, of every third a fact is known; user turns have a voice and first events a frame.
GRAPH = """t AS (SELECT conv_id AS s, turn AS i, turn // 3 AS n, role FROM conversations), ev AS (SELECT s, n, min(i) AS i, arg_min(role, i) AS role FROM t GROUP BY ALL), fa AS (SELECT * FROM ev WHERE (s + n) % 3 = 0),
 u AS (SELECT s, i, n, 'utterance|' || s || '|' || i AS u, 'segment|' || s AS g, 'slice|' || s AS c, 'event|' || s || '|' || n AS e, 'entity|' || role AS r, role FROM t),
 x AS (SELECT g AS a, u AS b, 'CONTAINS_EVIDENCE' AS r, 'media_segment' AS ak, 'utterance' AS bk FROM u UNION SELECT c, u, 'TEMPORALLY_CONTAINS', 'time_slice', 'utterance' FROM u UNION SELECT u, r, 'SPOKEN_BY', 'utterance', 'entity' FROM u
 UNION SELECT c, g, 'COVERS_SEGMENT', 'time_slice', 'media_segment' FROM u UNION SELECT c, e, 'COVERS_EVENT', 'time_slice', 'event' FROM u UNION SELECT e, c, 'OCCURS_AT', 'event', 'time_slice' FROM u UNION SELECT e, g, 'SUMMARIZES', 'event', 'media_segment' FROM u
 UNION SELECT e, u, 'SUPPORTED_BY', 'event', 'utterance' FROM u UNION SELECT e, r, 'INVOLVES', 'event', 'entity' FROM u UNION SELECT e, 'entity|guest ' || s % 7, 'INVOLVES', 'event', 'entity' FROM u WHERE (s + n) % 2 = 0 UNION SELECT e, 'place|' || s % 5, 'OCCURS_AT', 'event', 'place' FROM u WHERE (s + n) % 2 = 0
 UNION SELECT DISTINCT 'event|' || s || '|' || n, 'event|' || s || '|' || m, 'NEXT_EVENT', 'event', 'event' FROM (SELECT s, n, lead(n) OVER (PARTITION BY s ORDER BY n) AS m FROM ev) WHERE m IS NOT NULL
 UNION SELECT 'slice|' || s, 'fact|' || s || '|' || n, 'CONTAINS', 'time_slice', 'knowledge' FROM fa UNION SELECT 'fact|' || s || '|' || n, 'event|' || s || '|' || n, 'DERIVED_FROM', 'knowledge', 'event' FROM fa UNION SELECT 'fact|' || s || '|' || n, 'utterance|' || s || '|' || i, 'SUPPORTED_BY', 'knowledge', 'utterance' FROM fa
 UNION SELECT 'fact|' || s || '|' || n, 'entity|' || role, 'STATED_BY', 'knowledge', 'entity' FROM fa UNION SELECT 'fact|' || s || '|' || n, 'entity|guest ' || s % 7, 'MENTIONS', 'knowledge', 'entity' FROM fa
 UNION SELECT u, 'evidence|v' || s || '-' || i, 'SUPPORTED_BY', 'utterance', 'evidence' FROM u WHERE role = 'user' UNION SELECT e, 'evidence|f' || s, 'SUPPORTED_BY', 'event', 'evidence' FROM u WHERE n = 0)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = S.turns(spark, d).withColumn("n", F.floor(F.col("idx") / 3))
    s, even = F.col("session_id"), (F.col("session_id") + F.col("n")) % 2 == 0
    guest, none = F.concat(F.lit(" Guest  "), (s % 7).cast("string")), F.array().cast("array<string>")
    e = t.groupBy("session_id", "n").agg(F.collect_set("idx").alias("turn_idx"), F.min(F.struct("idx", "speaker")).alias("first"))
    events = e.select("session_id", "n", F.concat("turn_idx", F.array(F.lit(-1).cast("long"))).cast("array<bigint>").alias("turn_idx"), F.when(even, F.array(guest, F.lit(" "))).otherwise(none).alias("participants"), F.when(even, s % 5).alias("place"))
    facts = e.filter((s + F.col("n")) % 3 == 0).select("session_id", F.col("n").alias("k"), F.array("n").alias("events"), F.array("first.idx").alias("turn_idx"), "first.speaker", F.array(guest).alias("about"))
    voices = t.filter("speaker = 'user'").select("session_id", "idx", F.concat(F.lit("v"), s.cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("evidence_id"))
    frames = events.filter("n = 0").select("session_id", "n", F.concat(F.lit("f"), s.cast("string")).alias("evidence_id"))
    return O.dialog_edges(t, events, facts, voices, frames)


@query("dialog_edges", f"WITH {GRAPH} SELECT a AS src_id, b AS dst_id, r AS rel_type, ak AS src_type, bk AS dst_type FROM x")
def dialog_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the conversations' graphs."""
    return _edges(spark, d)


def _branch(name: str, where: str) -> str:
    return f"SELECT event, '{name}' AS branch, item FROM ({where})"


BUNDLE = f"""{GRAPH}, k AS (SELECT b AS event, a AS item FROM x WHERE r = 'DERIVED_FROM'), said AS (SELECT a AS event, b AS item FROM x WHERE r = 'SUPPORTED_BY' AND ak = 'event' AND bk = 'utterance'),
 w AS ({' UNION '.join([
    _branch('segments', "SELECT a AS event, b AS item FROM x WHERE r = 'SUMMARIZES'"), _branch('entities', "SELECT a AS event, b AS item FROM x WHERE r = 'INVOLVES' UNION SELECT event, b FROM k JOIN x ON a = item AND r = 'STATED_BY'"),
    _branch('places', "SELECT a AS event, b AS item FROM x WHERE r = 'OCCURS_AT' AND bk = 'place'"), _branch('evidences', "SELECT a AS event, b AS item FROM x WHERE r = 'SUPPORTED_BY' AND ak = 'event' AND bk = 'evidence'"),
    _branch('utterances', "SELECT * FROM said UNION SELECT event, b FROM k JOIN x ON a = item AND r = 'SUPPORTED_BY'"), _branch('speakers', "SELECT event, b AS item FROM said JOIN x ON a = item AND r = 'SPOKEN_BY'"),
    _branch('voices', "SELECT event, b AS item FROM said JOIN x ON a = item AND r = 'SUPPORTED_BY' AND bk = 'evidence'"), _branch('slices', "SELECT b AS event, a AS item FROM x WHERE r = 'COVERS_EVENT'"), _branch('knowledge', 'SELECT * FROM k'),
    _branch('next', "SELECT a AS event, b AS item FROM x WHERE r = 'NEXT_EVENT'")])}),
 l AS (SELECT event AS id, {', '.join(f"coalesce(string_agg(DISTINCT item, ',' ORDER BY item) FILTER (branch = '{b}'), '') AS {b}" for b in O.BRANCHES)} FROM w GROUP BY 1)"""


@query("event_bundle", f"WITH {BUNDLE} SELECT * FROM l")
def event_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its segment, entities, places, evidences, utterances, speakers, voices, slices, knowledge and what follows."""
    edges = _edges(spark, d)
    events = edges.filter("rel_type = 'COVERS_EVENT'").select(F.col("dst_id").alias("id"))
    out = O.event_bundle(edges, events)
    return out.select("id", *(F.array_join(b, ",").alias(b) for b in O.BRANCHES))


@query("events_filtered", f"WITH {BUNDLE} SELECT id, entities, places, next FROM l WHERE contains(',' || entities || ',', ',entity|guest 3,') AND contains(',' || places || ',', ',place|3,') AND next <> ''")
def events_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Events with a guest, at a place, that another one follows."""
    edges = _edges(spark, d)
    out = O.choose_events(O.event_bundle(edges, edges.filter("rel_type = 'COVERS_EVENT'").select(F.col("dst_id").alias("id"))), entity="entity|guest 3", place="place|3", relation="NEXT_EVENT")
    return out.select("id", *(F.array_join(b, ",").alias(b) for b in ("entities", "places", "next")))


TIMED = f"""{GRAPH}, te AS (SELECT 'event|' || s || '|' || n AS id, TIMESTAMP '2024-01-01' + (s * 100 + n) * INTERVAL 1 MINUTE AS t, CASE WHEN s % 3 = 0 THEN 'talk/short' WHEN s % 3 = 1 THEN 'talk/long/' || n % 2 ELSE 'other' END AS topic FROM ev),
 tu AS (SELECT 'utterance|' || conv_id || '|' || turn AS id, TIMESTAMP '2024-01-01' + (conv_id * 100 + turn) * INTERVAL 1 MINUTE AS t, left(text, 20) AS text FROM conversations),
 inv AS (SELECT a AS item, b AS id FROM x WHERE r = 'INVOLVES')"""


def _timed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events (id, t, topic_path) and utterances (id, t, text) of the conversations."""
    t = S.turns(spark, d).withColumn("n", F.floor(F.col("idx") / 3))
    at = lambda c: timestamp("2024-01-01") + F.make_dt_interval(mins=(F.col("session_id") * 100 + F.col(c)).cast("int"))
    path = F.when(F.col("session_id") % 3 == 0, "talk/short").when(F.col("session_id") % 3 == 1, F.concat(F.lit("talk/long/"), (F.col("n") % 2).cast("string"))).otherwise("other")
    events = t.select("session_id", "n").distinct().select(O.node_id("event", "session_id", "n").alias("id"), at("n").alias("t"), path.alias("topic_path"))
    return events, t.select(O.node_id("utterance", "session_id", "idx").alias("id"), at("idx").alias("t"), F.substring("text", 1, 20).alias("text"))


def _top(name: str, table: str, key: str, order: str, item: str) -> str:
    return f"{name} AS (SELECT {key}, string_agg({item}, ';' ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {table}) WHERE k <= 3 GROUP BY 1)"


@query("entity_profiles", f"""WITH {TIMED}, ask AS (SELECT DISTINCT id FROM inv), oe AS (SELECT inv.id, item, t FROM inv JOIN te ON te.id = item), se AS (SELECT id, count(*) AS events, min(t) AS first_t, max(t) AS last_t FROM oe GROUP BY 1),
 rl AS (SELECT a.id, b.id AS other, count(*) AS n FROM inv a JOIN inv b ON a.item = b.item AND a.id <> b.id GROUP BY 1, 2), qs AS (SELECT x.b AS id, x.a AS item, t, text FROM x JOIN tu ON tu.id = x.a WHERE r = 'SPOKEN_BY'), fc AS (SELECT b AS id, count(*) AS facts FROM x WHERE r = 'STATED_BY' GROUP BY 1),
 st AS (SELECT 'entity|guest ' || user_id % 7 AS id, event_type AS p, arg_max('v' || event_id % 5, (ts, event_id)) AS v FROM events GROUP BY 1, 2), ss AS (SELECT id, string_agg(p || '=' || v, ';' ORDER BY p) AS states FROM st GROUP BY 1),
 {_top('recent', 'oe', 'id', 't DESC, item', 'item')}, {_top('related', 'rl', 'id', 'n DESC, other', "other || '=' || n")}, {_top('quotes', 'qs', 'id', 't DESC, item', 'text')}
 SELECT id, events, first_t, last_t, recent, coalesce(related, '') AS related, coalesce(quotes, '') AS quotes, coalesce(facts, 0) AS facts, coalesce(states, '') AS states FROM ask JOIN se USING (id) LEFT JOIN recent USING (id) LEFT JOIN related USING (id) LEFT JOIN quotes USING (id) LEFT JOIN fc USING (id) LEFT JOIN ss USING (id)""")
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Everyone in the conversations: when, with whom, what they said, and their states."""
    edges, (events, utterances) = _edges(spark, d), _timed(spark, d)
    e = S.events(spark, d)
    states = e.select(F.concat(F.lit("entity|guest "), (F.col("user_id") % 7).cast("string")).alias("subject"), F.col("action").alias("property"), F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("value"), F.col("t").alias("valid_from"), "id")
    asked = edges.filter("rel_type = 'INVOLVES'").select(F.col("dst_id").alias("id"))
    out = P.entity_profiles(asked, edges, events, utterances, states, 3)
    line = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    named = lambda k, v: lambda x: F.concat_ws("=", x[k], x[v].cast("string"))
    return out.select("id", "events", "first_t", "last_t", line("recent", lambda x: x["id"]), line("related", named("id", "events")), line("quotes", lambda x: x["text"]), "facts", line("states", named("property", "value")))


@query("topic_timelines", f"""WITH {TIMED}, ask AS (SELECT unnest(['talk', 'talk/long', 'talk/long/1', 'other', 'none']) AS topic_path), oe AS (SELECT topic_path, id AS item, t FROM ask JOIN te ON topic = topic_path OR starts_with(topic, topic_path || '/')),
 se AS (SELECT topic_path, count(*) AS events, max(t) AS last_t FROM oe GROUP BY 1), pe AS (SELECT topic_path, inv.id AS who, count(*) AS n FROM oe JOIN inv USING (item) GROUP BY 1, 2), qs AS (SELECT DISTINCT topic_path, tu.id AS item, tu.t, text FROM oe JOIN x ON x.a = item AND r = 'SUPPORTED_BY' JOIN tu ON tu.id = x.b),
 {_top('entities', 'pe', 'topic_path', 'n DESC, who', "who || '=' || n")}, {_top('quotes', 'qs', 'topic_path', 't DESC, item', 'text')}, tl AS (SELECT topic_path, string_agg(item, ';' ORDER BY t, item) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY topic_path ORDER BY t DESC, item) AS k FROM oe) WHERE k <= 3 GROUP BY 1)
 SELECT topic_path, coalesce(events, 0) AS events, last_t, CASE WHEN last_t IS NULL THEN 'unknown' WHEN date_diff('day', CAST(last_t AS DATE), DATE '2024-01-20') <= 14 THEN 'ongoing' WHEN date_diff('day', CAST(last_t AS DATE), DATE '2024-01-20') <= 90 THEN 'paused' ELSE 'over' END AS status,
 coalesce(timeline, '') AS timeline, coalesce(entities, '') AS entities, coalesce(quotes, '') AS quotes FROM ask LEFT JOIN se USING (topic_path) LEFT JOIN tl USING (topic_path) LEFT JOIN entities USING (topic_path) LEFT JOIN quotes USING (topic_path)""")
def topic_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Topics and those above them, with who was there and what was said."""
    edges, (events, utterances) = _edges(spark, d), _timed(spark, d)
    asked = spark.createDataFrame([(p,) for p in ("talk", "talk/long", "talk/long/1", "other", "none")], "topic_path string")
    out = P.topic_timelines(asked, events, edges, utterances, timestamp("2024-01-20"), 3)
    line = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return out.select("topic_path", "events", "last_t", "status", line("timeline", lambda x: x["id"]), line("entities", lambda x: F.concat_ws("=", x["id"], x["events"].cast("string"))), line("quotes", lambda x: x["text"]))


@query("media_edges", """WITH v AS (SELECT event_id // 1000 AS s, event_id AS i, event_id * 13 % 5000 AS a, event_id * 7 % 5000 AS u, user_id % 23 AS p FROM events), w AS (SELECT s, n, n * 100 AS a, n * 100 + 120 AS b FROM (SELECT DISTINCT s FROM v), (SELECT unnest(range(0, 50)) AS n)),
 t AS (SELECT s, i, a, a + 20 + i % 7 AS b, CASE WHEN i % 10 > 0 THEN p END AS p FROM v WHERE i % 2 = 0), u AS (SELECT s, i, u AS a, u + 5 AS b, CASE WHEN i % 3 > 0 THEN i - 1 END AS k FROM v WHERE i % 2 = 1),
 wt AS (SELECT w.s, n, i, p FROM w JOIN t ON w.s = t.s AND w.a < t.b AND t.a < w.b), wu AS (SELECT w.s, n, i FROM w JOIN u ON w.s = u.s AND w.a < u.b AND u.a < w.b), x AS (SELECT w.s, w.n, w.n + 1 AS m FROM w WHERE n < 49), sp AS (SELECT u.s, u.i, t.i AS k, t.p FROM u JOIN t ON u.s = t.s AND u.k = t.i)
 SELECT 'event|' || s || '|' || n AS src_id, 'segment|' || s || '|' || n AS dst_id, 'SUMMARIZES' AS rel_type FROM w UNION SELECT 'slice|' || s || '|' || n, 'segment|' || s || '|' || n, 'COVERS_SEGMENT' FROM w UNION SELECT 'slice|' || s || '|' || n, 'event|' || s || '|' || n, 'COVERS_EVENT' FROM w
 UNION SELECT 'segment|' || s || '|' || n, 'segment|' || s || '|' || m, 'NEXT_SEGMENT' FROM x UNION SELECT 'event|' || s || '|' || n, 'event|' || s || '|' || m, 'NEXT_EVENT' FROM x UNION SELECT 'segment|' || s || '|' || n, 'evidence|' || s || '|' || i, 'CONTAINS_EVIDENCE' FROM wt
 UNION SELECT 'event|' || s || '|' || n, 'evidence|' || s || '|' || i, 'SUPPORTED_BY' FROM wt UNION SELECT 'event|' || s || '|' || n, 'entity|' || p, 'INVOLVES' FROM wt WHERE p IS NOT NULL UNION SELECT 'evidence|' || s || '|' || i, 'entity|' || p, 'BELONGS_TO_ENTITY' FROM t WHERE p IS NOT NULL
 UNION SELECT 'event|' || s || '|' || n, 'utterance|' || s || '|' || i, 'SUPPORTED_BY' FROM wu UNION SELECT 'utterance|' || s || '|' || i, 'evidence|' || s || '|' || k, 'SUPPORTED_BY' FROM sp UNION SELECT 'utterance|' || s || '|' || i, 'entity|' || p, 'SPOKEN_BY' FROM sp WHERE p IS NOT NULL""")
def media_edges(spark: SparkSession, d: str) -> DataFrame:
    """A thousand events are a source: every second one a track, the others utterances, some of the track before them; fifty windows each."""
    i = F.col("id")
    e = S.events(spark, d).select("id", "user_id", F.floor(i / 1000).alias("source_id"))
    tracks = e.filter("id % 2 = 0").select("source_id", i.alias("track"), F.when(i % 10 > 0, F.col("user_id") % 23).alias("entity"), (i * 13 % 5000).alias("start"), (i * 13 % 5000 + 20 + i % 7).alias("end"))
    said = e.filter("id % 2 = 1").select("source_id", i.alias("n"), (i * 7 % 5000).alias("start"), (i * 7 % 5000 + 5).alias("end"), F.when(i % 3 > 0, i - 1).alias("track"))
    windows = e.select("source_id").distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("source_id", "window", (F.col("window") * 100).alias("start"), (F.col("window") * 100 + 120).alias("end"))
    return O.media_edges(windows, tracks, said).select("src_id", "dst_id", "rel_type")
