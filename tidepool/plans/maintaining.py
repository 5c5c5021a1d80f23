"""Upserts, merges, lifetimes and other changes, shown as the table after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import timestamp
from ..operators import maintain as O
from ..sources import tables as S
from .registry import query

EDGE = "e AS (SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, 'SUPPLIED_BY' AS rel_type, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)"


def supply(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).filter("rel_type = 'SUPPLIED_BY'")


@query("node_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS kind FROM customer")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows are replaced whole, nulls too."""
    old = S.parquet(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").toDF("id", "name", "kind")
    new = old.filter("id % 10 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit("new").alias("kind"))
    return O.upsert(old, new, ["id"])


@query("node_merge", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS kind FROM customer")
def node_merge(spark: SparkSession, d: str) -> DataFrame:
    old = S.parquet(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").toDF("id", "name", "kind")
    new = old.filter("id % 10 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit("new").alias("kind"))
    return O.upsert(old, new, ["id"], merge_nulls=True)


@query("edge_merge_sum", f"WITH {EDGE} SELECT src_id, dst_id, rel_type, weight + CASE WHEN weight > 1 THEN 1 ELSE 0 END AS weight FROM e")
def edge_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    e = supply(spark, d)
    return O.merge_edges(e, e.filter("weight > 1").withColumn("weight", F.lit(None).cast("double")))


@query("edge_endpoints", f"WITH {EDGE} SELECT src_id, dst_id FROM e")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = S.parquet(spark, d, "part", "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    s = S.parquet(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return O.known_edges(supply(spark, d), p.union(s)).select("src_id", "dst_id")


@query("edge_decay", f"WITH {EDGE} SELECT src_id, dst_id, CASE WHEN weight > 1 THEN weight * 0.5 ELSE weight END AS weight FROM e")
def edge_decay(spark: SparkSession, d: str) -> DataFrame:
    return O.decay_edges(supply(spark, d), 0.5, 1.0, ["SUPPLIED_BY"]).select("src_id", "dst_id", "weight")


@query("dedup_merge", "SELECT lang, source, max(doc_id) AS id, count(*) AS merged FROM documents GROUP BY lang, source, md5(text)")
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    e = S.parquet(spark, d, "documents", "doc_id", "text", "lang", "source").withColumn("created_at", F.col("doc_id")).withColumnRenamed("doc_id", "id")
    return O.dedup_merge(e, ["lang", "source"]).select("lang", "source", "id", "merged")


@query("ttl_defaults", "SELECT event_id AS id, CAST(k AS DOUBLE) * 86400 AS ttl, CASE WHEN k > 0 THEN ts + k * INTERVAL 1 DAY END AS expires_at, k = 0 AS for_ever FROM (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 30 ELSE event_id % 3 END AS k FROM events)")
def ttl_defaults(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).select("id", F.when(F.col("action") != "view", (F.col("id") % 3) * 86400.0).alias("ttl"), F.col("t").alias("created_at"))
    return O.ttl_defaults(e, 30 * 86400.0, timestamp("2024-02-01")).select("id", "ttl", F.when(F.col("ttl") > 0, F.col("expires_at")).alias("expires_at"), (F.year("expires_at") == 9999).alias("for_ever"))


@query("ttl_expired", "SELECT event_id AS id FROM events WHERE event_id % 3 > 0 AND date_diff('microsecond', ts, TIMESTAMP '2024-01-20') / 1000000 >= (event_id % 3) * 86400 + 3601")
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).select("id", ((F.col("id") % 3) * 86400.0).alias("ttl"), F.col("t").alias("created_at"))
    return O.expired(e, timestamp("2024-01-20"), 3600.0).select("id")


@query("touch", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS last_accessed_at, CASE WHEN event_id % 5 = 0 AND event_id % 3 > 0 THEN TIMESTAMP '2024-02-01' + (event_id % 3) * INTERVAL 1 DAY ELSE ts END AS expires_at FROM events")
def touch(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).select("id", F.col("t").alias("last_accessed_at"), F.col("t").alias("expires_at"), ((F.col("id") % 3) * 86400.0).alias("ttl"))
    return O.touch(e, e.filter("id % 5 = 0"), timestamp("2024-02-01")).select("id", "last_accessed_at", "expires_at")


@query("publish_flag", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'false' WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 'true' ELSE 'false' END AS published FROM documents LEFT JOIN labels l USING (doc_id)")
def publish_flag(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d).select("id", "published")
    return O.publish(e, e.filter("id % 4 = 0"), False).select("id", F.col("published").cast("string").alias("published"))


@query("purge_keep_set", "SELECT doc_id AS id, source FROM documents WHERE source <> 'src8' OR doc_id % 2 = 0")
def purge_keep_set(spark: SparkSession, d: str) -> DataFrame:
    e = S.parquet(spark, d, "documents", "doc_id", "source").withColumnRenamed("doc_id", "id")
    return O.purge_except(e, "src8", e.filter("id % 2 = 0"))


@query("equiv_apply", """WITH e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b, CAST(s_suppkey % 7 AS DOUBLE) / 7 AS w FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_suppkey + 2, 0.25 FROM supplier),
 p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b, s_suppkey % 3 AS k FROM supplier)
 SELECT CAST(coalesce(e.a, p.a) AS BIGINT) AS src_id, CAST(coalesce(e.b, p.b) AS BIGINT) AS dst_id, 'EQUIV' AS rel_type, CAST(coalesce(e.w, 1.0) AS DOUBLE) AS weight FROM e FULL JOIN (SELECT * FROM p WHERE k < 2) p ON e.a = p.a AND e.b = p.b WHERE coalesce(p.k, 0) <> 1""")
def equiv_apply(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of both ways: approved ones add edges or leave those that are there, rejected ones take edges away, open ones change nothing."""
    s = S.parquet(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("long").alias("k"))
    there = s.filter("k % 2 = 0").select((F.col("k") + 1).alias("src_id"), F.col("k").alias("dst_id"), F.lit("EQUIV").alias("rel_type"), ((F.col("k") % 7) / 7).alias("weight"))
    edges = there.unionByName(s.select(F.col("k").alias("src_id"), (F.col("k") + 2).alias("dst_id"), F.lit("EQUIV").alias("rel_type"), F.lit(0.25).alias("weight")))
    status = F.when(F.col("k") % 3 == 0, "approved").when(F.col("k") % 3 == 1, "rejected").otherwise("pending")
    pending = s.select((F.col("k") + 1).alias("a"), F.col("k").alias("b"), status.alias("status"))
    return O.approve_equivalents(edges, pending.unionByName(pending.select(F.col("b").alias("a"), F.col("a").alias("b"), "status")))


@query("purge_cascade", """WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey % 5 < 4), kept AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM o)), gone AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT k FROM o) AND l_partkey NOT IN (SELECT p FROM kept)),
 s AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT p FROM gone) AND l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT p FROM gone)))
 SELECT 'Event' AS label, 0 AS "round", count(*) AS n FROM o UNION ALL SELECT 'Entity', 1, count(*) FROM gone HAVING count(*) > 0 UNION ALL SELECT 'Place', 2, count(*) FROM s HAVING count(*) > 0""")
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Most customers' orders go: parts that only they had go with them, and suppliers that only those parts had."""
    at = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o = S.parquet(spark, d, "orders", "o_orderkey", "o_custkey")
    line = S.parquet(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    nodes = o.select(at("o", "o_orderkey").alias("id"), F.lit("Event").alias("label")).unionByName(S.parquet(spark, d, "part", "p_partkey").select(at("p", "p_partkey").alias("id"), F.lit("Entity").alias("label")))
    nodes = nodes.unionByName(S.parquet(spark, d, "supplier", "s_suppkey").select(at("s", "s_suppkey").alias("id"), F.lit("Place").alias("label")))
    edges = line.select(at("o", "l_orderkey").alias("src_id"), at("p", "l_partkey").alias("dst_id"), F.lit("INVOLVES").alias("rel_type")).union(line.select(at("p", "l_partkey"), at("s", "l_suppkey"), F.lit("SUPPLIED_BY")))
    _, _, went = O.purge(nodes, edges, o.filter("o_custkey % 5 < 4").select(at("o", "o_orderkey").alias("id")), ["Entity", "Place"])
    return went.groupBy("label", "round").agg(F.count(F.lit(1)).alias("n"))


@query("audit_latest", "SELECT user_id AS object_id, max(event_id) AS seq, arg_max(event_type, event_id) AS snapshot FROM events GROUP BY 1")
def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    return O.history(S.events(spark, d).select(F.col("user_id").alias("object_id"), F.col("id").alias("seq"), F.col("action").alias("snapshot")))


@query("audit_rollback", "SELECT user_id AS object_id, max(event_id) AS seq, arg_max(event_type, event_id) AS snapshot FROM events WHERE event_id < 300 GROUP BY 1")
def audit_rollback(spark: SparkSession, d: str) -> DataFrame:
    return O.rollback(S.events(spark, d).select(F.col("user_id").alias("object_id"), F.col("id").alias("seq"), F.col("action").alias("snapshot")), 300)


@query("turn_chunking", "SELECT conv_id AS session_id, turn AS idx, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations")
def turn_chunking(spark: SparkSession, d: str) -> DataFrame:
    return O.chunked_turns(S.turns(spark, d), 3).select("session_id", "idx", "chunk")


@query("turn_timestamp_fill", "WITH k AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE turn % 2 = 1 GROUP BY 1) SELECT conv_id AS session_id, turn AS idx, CASE WHEN turn % 2 = 1 THEN TIMESTAMP '2024-01-01' + turn * INTERVAL 1 HOUR ELSE TIMESTAMP '2024-01-01' + f * INTERVAL 1 HOUR + (turn - f) * INTERVAL 30 SECOND END AS t FROM conversations LEFT JOIN k USING (conv_id)")
def turn_timestamp_fill(spark: SparkSession, d: str) -> DataFrame:
    t = S.turns(spark, d).select("session_id", "idx", F.when(F.col("idx") % 2 == 1, timestamp("2024-01-01") + F.make_dt_interval(hours=F.col("idx").cast("int"))).alias("t"))
    return O.fill_times(t, 30.0).select("session_id", "idx", "t")


@query("character_rows", "SELECT DISTINCT c_mktsegment AS character, 'structured' AS modality FROM customer")
def character_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "customer", "c_mktsegment").distinct().select(F.col("c_mktsegment").alias("character"), F.lit("structured").alias("modality"))


@query("stale_difference", "SELECT doc_id AS id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM documents WHERE source = 'src9'")
def stale_difference(spark: SparkSession, d: str) -> DataFrame:
    e = S.parquet(spark, d, "documents", "doc_id", "lang", "source").withColumnRenamed("doc_id", "id")
    return e.filter("lang = 'en'").select("id").exceptAll(e.filter("source = 'src9'").select("id")).distinct()
