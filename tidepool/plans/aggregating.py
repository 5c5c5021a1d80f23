"""Overviews, co-occurrence statistics, coverage, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import seconds
from ..operators import derive as O
from ..sources import tables as S
from .registry import query

INV = "inv AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem)"


@query("entities_overview", f"WITH {INV} SELECT entity_id, count(DISTINCT event_id) AS mentions, min(o_orderdate) AS first_t, max(o_orderdate) AS last_t FROM inv JOIN orders ON o_orderkey = event_id GROUP BY 1 ORDER BY last_t DESC, mentions DESC, entity_id LIMIT 50 OFFSET 10")
def entities_overview(spark: SparkSession, d: str) -> DataFrame:
    return O.entities_overview(S.involves(spark, d), S.order_events(spark, d)).orderBy(F.desc("last_t"), F.desc("mentions"), "entity_id").offset(10).limit(50)


@query("entities_overview_count", f"WITH {INV} SELECT count(DISTINCT entity_id) AS n FROM inv JOIN orders ON o_orderkey = event_id")
def entities_overview_count(spark: SparkSession, d: str) -> DataFrame:
    return O.entities_overview(S.involves(spark, d), S.order_events(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("topics_overview", "SELECT 'activity/' || event_type AS topic_path, count(*) AS events, min(ts) AS first_t, max(ts) AS last_t FROM events GROUP BY 1 HAVING count(*) >= 100")
def topics_overview(spark: SparkSession, d: str) -> DataFrame:
    return O.topics_overview(S.events(spark, d), 100)


@query("topics_overview_count", "SELECT count(*) AS n FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 100)")
def topics_overview_count(spark: SparkSession, d: str) -> DataFrame:
    return O.topics_overview(S.events(spark, d), 100).agg(F.count(F.lit(1)).alias("n"))


@query("timeslice_build", "SELECT 'hour' AS granularity, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS slice, count(*) AS events FROM events GROUP BY ALL UNION ALL SELECT 'day', CAST(date_trunc('day', ts) AS TIMESTAMP), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'month', CAST(date_trunc('month', ts) AS TIMESTAMP), count(*) FROM events GROUP BY ALL")
def timeslice_build(spark: SparkSession, d: str) -> DataFrame:
    return O.time_slices(S.events(spark, d), {"hour": "hour", "day": "day", "month": "month"}).withColumn("slice", F.col("slice").cast("timestamp_ntz"))


@query("place_visits", "SELECT n_name AS place, count(*) AS visits FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY visits DESC, place LIMIT 10")
def place_visits(spark: SparkSession, d: str) -> DataFrame:
    e = S.order_events(spark, d).filter("priority = '1-URGENT'").select(F.col("id").alias("event_id"))
    v = e.join(S.occurs_at(spark, d), "event_id").groupBy("place_id").agg(F.count(F.lit(1)).alias("visits"))
    return v.join(S.places(spark, d).select(F.col("id").alias("place_id"), F.col("name").alias("place")), "place_id").select("place", "visits").orderBy(F.desc("visits"), "place").limit(10)


@query("domain_distribution", "SELECT lang AS memory_domain, count(*) AS n FROM documents GROUP BY 1")
def domain_distribution(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "lang").groupBy(F.col("lang").alias("memory_domain")).agg(F.count(F.lit(1)).alias("n"))


@query("count_by_tenant", "SELECT source AS tenant_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def count_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "source", "doc_id").groupBy(F.col("source").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("timeline_summary", "WITH r AS (SELECT user_id AS clip, ts AS t, event_id AS id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT clip, min(t) AS first_t, max(t) AS last_t, count(*) AS hits, string_agg(text, ' | ' ORDER BY k) FILTER (k <= 3) AS summary FROM r GROUP BY 1")
def timeline_summary(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d)
    return O.clip_summary(e.select(F.col("user_id").alias("clip"), "t", "id", F.col("action").alias("text")), 3)


@query("usage_summary", "SELECT event_type AS kind, sum(event_id % 100) AS prompt_tokens, sum(user_id) AS completion_tokens, sum(CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN event_id % 100 + user_id ELSE event_id % 7 END) AS total_tokens, round(sum(CASE WHEN event_type = 'view' THEN NULL ELSE value END), 4) AS cost FROM events GROUP BY 1")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).select(F.col("action").alias("kind"), (F.col("id") % 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("total_tokens"), F.when(F.col("action") != "view", F.col("value")).alias("cost"))
    return O.usage(e, ["kind"]).withColumn("cost", F.round("cost", 4))


@query("ttl_merge", "SELECT o_custkey AS k, CASE WHEN count(x) > 0 THEN coalesce(min(CASE WHEN x > 0 THEN x END), 0) ELSE -1 END AS ttl FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 5 < 2 THEN 0 ELSE o_orderkey % 5 END AS x FROM orders) GROUP BY 1")
def ttl_merge(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("status") != "P", F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 5))
    return S.order_events(spark, d).select(F.col("actor_id").alias("k"), x.alias("x")).groupBy("k").agg(F.coalesce(O.merged_ttl(F.col("x")), F.lit(-1)).alias("ttl"))


@query("forget_policy_merge", "SELECT o_custkey AS k, arg_min(p, r) AS policy FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'until_changed' WHEN 'F' THEN 'permanent' ELSE 'temporary' END AS p, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS r FROM orders) GROUP BY 1")
def forget_policy_merge(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("status") == "P", "until_changed").when(F.col("status") == "F", "permanent").otherwise("temporary")
    return S.order_events(spark, d).select(F.col("actor_id").alias("k"), p.alias("p")).groupBy("k").agg(O.merged_policy(F.col("p")).alias("policy"))


@query("importance_rollup", "SELECT o_custkey AS k, greatest(max(o_totalprice), max(c_acctbal)) AS importance FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def importance_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = S.parquet(spark, d, "customer", "c_custkey", "c_acctbal")
    o = S.order_events(spark, d).groupBy(F.col("actor_id").alias("k")).agg(F.max("importance").alias("most"))
    return o.join(c, F.col("k") == F.col("c_custkey")).select("k", F.greatest("most", "c_acctbal").alias("importance"))


@query("coverage_report", "SELECT count(*) AS events, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS topic, round(count(*) FILTER (value > 100) / count(*), 4) AS tagged FROM events")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return O.coverage(S.events(spark, d), {"topic": F.col("action") != "error", "tagged": F.col("value") > 100})


@query("property_distribution", "SELECT 'url' AS property, count(*) FILTER (regexp_matches(text, 'https?://')) AS hits FROM documents UNION ALL SELECT 'mail', count(*) FILTER (regexp_matches(text, '[a-z]+@[a-z]+')) FROM documents UNION ALL SELECT 'number', count(*) FILTER (regexp_matches(text, '[0-9]{4}')) FROM documents")
def property_distribution(spark: SparkSession, d: str) -> DataFrame:
    return O.rule_hits(S.parquet(spark, d, "documents", "text"), {"url": "https?://", "mail": "[a-z]+@[a-z]+", "number": "[0-9]{4}"})


@query("histogram", "SELECT CAST(CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 END AS DOUBLE) AS le, count(*) AS n FROM events GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.histogram(S.events(spark, d), "value", [10, 50, 100])


@query("percentiles", "SELECT event_type AS action, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = O.percentiles(S.events(spark, d), ["action"], "value", [0.5, 0.95, 0.99])
    return p.select("action", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("nearest_rank", "SELECT event_type AS action, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even(0.95 * (n - 1), 0)")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return O.nearest_rank(S.events(spark, d), ["action"], "value", 0.95)


@query("semantic_summary", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (event_type IN ('click', 'view')) AS episodic, count(*) FILTER (event_type = 'purchase') AS semantic FROM events GROUP BY 1")
def semantic_summary(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d)
    ids = F.sort_array(F.collect_list(F.when(F.col("action").isin("click", "view"), F.col("id"))))
    return e.groupBy("user_id").agg(F.nullif(F.array_join(ids, ","), F.lit("")).alias("episodic"), F.count_if(F.col("action") == "purchase").alias("semantic"))


@query("action_duration", "SELECT event_type AS action, round(sum(value) / 60, 4) AS minutes FROM events GROUP BY 1")
def action_duration(spark: SparkSession, d: str) -> DataFrame:
    """Minutes of each action: events last `value` seconds."""
    e = S.events(spark, d).withColumn("end", F.col("t") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)")))
    return e.groupBy("action").agg(F.round(F.sum(seconds(F.col("end"), F.col("t"))) / 60, 4).alias("minutes"))
