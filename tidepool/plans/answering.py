"""High-level questions: profiles, timelines, quotes, time since, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import timestamp
from ..operators import derive as D
from ..operators import graph as G
from ..sources import tables as S
from .registry import query


@query("topic_timeline", "SELECT event_id AS id, ts AS t, user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' ORDER BY t, id LIMIT 100")
def topic_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).filter((F.col("action") == "purchase") & (F.col("t") >= timestamp("2024-01-05")))
    return e.select("id", "t", "user_id").orderBy("t", "id").limit(100)


@query("time_since_topic_entity", "SELECT user_id, max(ts) AS last_t, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS days FROM events WHERE event_type = 'purchase' GROUP BY 1")
def time_since_topic_entity(spark: SparkSession, d: str) -> DataFrame:
    """The true last mention of a topic by an entity; no limit cuts it first."""
    e = S.events(spark, d).filter("action = 'purchase'").groupBy("user_id").agg(F.max("t").alias("last_t"))
    return e.select("user_id", "last_t", F.greatest(F.lit(0), F.datediff(F.lit("2024-02-01").cast("date"), F.col("last_t").cast("date"))).cast("long").alias("days"))


@query("quotes", "SELECT conv_id AS session_id, turn AS idx, text FROM conversations WHERE role = 'user' ORDER BY idx DESC, session_id LIMIT 50")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    """What one speaker said, newest first."""
    t = S.turns(spark, d).filter("speaker = 'user'")
    return t.select("session_id", "idx", "text").orderBy(F.desc("idx"), "session_id").limit(50)


@query("entity_profile", """WITH inv AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem), own AS (SELECT event_id, o_orderdate AS t FROM inv JOIN orders ON o_orderkey = event_id WHERE entity_id = 1)
SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM own) AS events, (SELECT max(t) FROM own) AS last_t, (SELECT count(DISTINCT i.entity_id) FROM inv i JOIN own USING (event_id) WHERE i.entity_id <> 1) AS related, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = 1) AS facts FROM part WHERE p_partkey = 1""")
def entity_profile(spark: SparkSession, d: str) -> DataFrame:
    """Detail, events, relations and facts of one entity; each branch is one row before it is joined."""
    inv, ev = S.involves(spark, d), S.order_events(spark, d)
    head = S.parquet(spark, d, "part", "p_partkey", "p_name").filter("p_partkey = 1").toDF("id", "name")
    seen = D.entities_overview(inv.filter("entity_id = 1"), ev).select(F.col("mentions").alias("events"), "last_t")
    related = G.relations_of(inv, ev, 1).agg(F.count(F.lit(1)).alias("related"))
    facts = S.parquet(spark, d, "lineitem", "l_partkey", "l_suppkey").filter("l_partkey = 1").agg(F.count_distinct("l_suppkey").alias("facts"))
    out = head
    for branch in (seen, related, facts):
        out = out.join(F.broadcast(branch), how="left")  # one row each
    return out.withColumn("events", F.coalesce("events", F.lit(0)))


@query("list_entities", "SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS events FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY events DESC, id LIMIT 30")
def list_entities(spark: SparkSession, d: str) -> DataFrame:
    o = S.order_events(spark, d).groupBy(F.col("actor_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    c = S.parquet(spark, d, "customer", "c_custkey", "c_name").toDF("id", "name")
    return c.join(o, "id", "left").select("id", "name", F.coalesce("events", F.lit(0)).alias("events")).orderBy(F.desc("events"), "id").limit(30)


@query("entity_action_anchor", "SELECT user_id, event_type AS action, min(ts) AS first_t, max(ts) AS last_t, count(*) AS n FROM events WHERE user_id IN (1, 2, 3) AND event_type = 'click' GROUP BY 1, 2")
def entity_action_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).filter("user_id IN (1, 2, 3) AND action = 'click'")
    return e.groupBy("user_id", "action").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


@query("object_search", "SELECT q AS object, p_partkey AS id FROM (SELECT unnest(['ring', 'widget', 'gear']) AS q), part WHERE contains(lower(p_name), q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY p_partkey) <= 5")
def object_search(spark: SparkSession, d: str) -> DataFrame:
    """Several objects at once: a short list of words against names."""
    from ..operators.scoring import top

    words = spark.createDataFrame([(w,) for w in ("ring", "widget", "gear")], "object string")
    p = S.parquet(spark, d, "part", "p_partkey", "p_name").toDF("id", "name")
    hits = p.join(F.broadcast(words), F.contains(F.lower("name"), F.col("object"))).withColumn("score", F.lit(1.0))
    return top(hits, ["object"], 5).select("object", "id")


@query("speech_search", "SELECT conv_id AS session_id, turn AS idx, role AS speaker FROM conversations WHERE contains(lower(text), 'the ')")
def speech_search(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.filters import contains_text

    return S.turns(spark, d).filter(contains_text("the ", "text")).select("session_id", "idx", "speaker")


@query("dialog_graph", """SELECT 'CONTAINS' AS rel_type, count(*) AS n FROM conversations UNION ALL SELECT 'SPOKEN_BY', count(*) FROM conversations UNION ALL SELECT 'NEXT_EVENT', count(*) - count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'MENTIONS', count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')) HAVING count(*) > 0""")
def dialog_graph(spark: SparkSession, d: str) -> DataFrame:
    """How many edges of each relation a dialogue's graph has."""
    t = S.turns(spark, d)
    named = t.filter(F.contains(F.lower("text"), F.lit("the"))).select("session_id", "idx", F.lit("The").alias("entity"))
    return D.build_session_graph(t, named)["edge"].groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("utterance_index", "SELECT conv_id AS session_id, turn AS idx, role || ': ' || text AS text FROM conversations")
def utterance_index(spark: SparkSession, d: str) -> DataFrame:
    return S.turns(spark, d).select("session_id", "idx", F.concat_ws(": ", "speaker", "text").alias("text"))
