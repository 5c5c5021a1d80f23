"""Scalar functions over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from .registry import query

DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query("uuid5_ids", "WITH h AS (SELECT c_custkey AS id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 1) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid FROM h")
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), T.uuid5(DNS, F.col("c_name")).alias("uuid"))


@query("stable_hash_ids", "SELECT c_custkey AS id, 'ent_' || substr(sha256(CAST(c_custkey AS VARCHAR) || '|' || c_name || '|<none>'), 1, 16) AS stable_id FROM customer")
def stable_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), T.stable_id("ent", F.col("c_custkey"), F.col("c_name"), F.lit(None)).alias("stable_id"))


@query("topic_key_id", "WITH k AS (SELECT p_partkey AS id, 'v1|path=' || p_type || '|basis=' || p_brand || '|kw=' || array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS k FROM part) SELECT id, k AS \"key\", 'tpk_' || substr(sha1(k), 1, 16) AS topic_id FROM k")
def topic_key_id(spark: SparkSession, d: str) -> DataFrame:
    k = T.topic_key(F.col("p_type"), F.col("p_brand"), F.split("p_name", " "))
    return S.parquet(spark, d, "part").select(F.col("p_partkey").alias("id"), k.alias("key"), T.topic_id(k).alias("topic_id"))


@query("topic_normalise", "SELECT p_partkey AS id, CASE WHEN 'part/' || lower(p_type) IN ('part/economy', 'part/promo') THEN 'part/' || lower(p_type) WHEN regexp_matches(lower(p_name), 'ring|chain') THEN 'wear/jewelry' WHEN regexp_matches(lower(p_name), 'widget') THEN 'tool/widget' ELSE '_uncategorized/general' END AS topic_path FROM part")
def topic_normalise(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("part/"), F.lower("p_type"))
    topic = T.normalised_topic(path, F.col("p_name"), ["part/economy", "part/promo"], {"wear/jewelry": ["ring", "chain"], "tool/widget": ["widget"]})
    return S.parquet(spark, d, "part").select(F.col("p_partkey").alias("id"), topic.alias("topic_path"))


@query("topic_token", "SELECT DISTINCT p_type AS raw, regexp_replace(regexp_replace(lower(trim(p_type)), '[\\s\\-_]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS token FROM part")
def topic_token(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "part", "p_type").distinct().select(F.col("p_type").alias("raw"), T.topic_token(F.col("p_type")).alias("token"))


@query("keyword_derive", "SELECT item_id AS id, array_to_string(list_slice(w, 1, 8), ',') AS keywords FROM (SELECT item_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i AND a[i] NOT IN ('that', 'and', 'the', 'with') THEN a[i] END), lambda x: x IS NOT NULL) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}]{3,}') AS a FROM benchmark))")
def keyword_derive(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(T.keywords(F.col("text"), ["that", "and", "the", "with"]), ",").alias("keywords"))


@query("proper_names", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{M}\\p{N}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{M}\\p{N}_])([A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,})*)(?:$|[^\\p{L}\\p{M}\\p{N}_])', 1), lambda x: replace(replace(x, '  ', ' '), chr(10) || chr(10), chr(10))), ',') AS names FROM conversations")
def proper_names(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.proper_names(F.col("text")), ",").alias("names"))


@query("turn_refs", "SELECT conv_id, turn, CAST(turn AS INTEGER) AS n FROM conversations")
def turn_refs(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return S.parquet(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", T.turn_number(ref).alias("n"))


@query("durations", "SELECT event_id AS id, CAST(CASE event_type WHEN 'click' THEN k * 86400 WHEN 'view' THEN k * 3600 WHEN 'error' THEN k * 60 ELSE k END AS DOUBLE) AS seconds FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("action") == "click", "d").when(F.col("action") == "view", "h").when(F.col("action") == "error", "m").otherwise("")
    return S.events(spark, d).select("id", T.duration_seconds(F.concat(F.col("k").cast("string"), unit)).alias("seconds"))


@query("time_buckets", "SELECT event_id AS id, strftime(ts, '%Y') || ',' || strftime(ts, '%Y-%m') || ',' || strftime(ts, '%Y-%m-%d') AS buckets FROM events")
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).select("id", F.array_join(T.time_bucket(F.col("t")), ",").alias("buckets"))


@query("speaker_split", "SELECT conv_id, turn, role AS speaker, text AS body FROM conversations")
def speaker_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.speaker(F.concat_ws(": ", "role", "text"))
    return S.parquet(spark, d, "conversations").select("conv_id", "turn", s["speaker"].alias("speaker"), s["body"].alias("body"))


@query("summary_truncate", "SELECT doc_id AS id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS summary FROM documents")
def summary_truncate(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), T.shortened(F.col("text"), 200).alias("summary"))


@query("content_fingerprint", "SELECT doc_id AS id, md5(text) AS fingerprint FROM documents")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.md5(F.encode("text", "utf-8")).alias("fingerprint"))


@query("governance_scores", "SELECT o_orderkey AS id, CAST(v AS DOUBLE) AS importance, CAST(0.5 + CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0 END AS DOUBLE) AS stability, CASE WHEN v >= 0.8 THEN 0 WHEN v >= 0.6 THEN 604800 ELSE 86400 END AS ttl FROM (SELECT *, 0.5 + CASE WHEN o_totalprice > 200000 THEN 0.1 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.1 ELSE 0 END AS v FROM orders)")
def governance_scores(spark: SparkSession, d: str) -> DataFrame:
    o = S.order_events(spark, d)
    v, s, t = T.governance(F.col("importance") > 200000, F.col("priority") == "1-URGENT", F.col("status") == "F")
    return o.select("id", F.round(v, 6).alias("importance"), F.round(s, 6).alias("stability"), t.alias("ttl"))


@query("domain_governance", """SELECT doc_id AS id, CAST(CASE WHEN doc_id % 5 = 0 THEN 60 WHEN lang = 'en' THEN 7200 WHEN lang = 'fr' THEN 172800 ELSE 60 END AS DOUBLE) AS ttl,
 CAST(round(CASE WHEN doc_id % 7 = 0 THEN (doc_id % 10) / 10.0 ELSE greatest(0, least(1, (doc_id % 10) / 10.0 + CASE lang WHEN 'en' THEN 0.3 WHEN 'fr' THEN -0.4 WHEN 'de' THEN 0.05 ELSE 0 END)) END, 6) AS DOUBLE) AS importance FROM documents""")
def domain_governance(spark: SparkSession, d: str) -> DataFrame:
    """Languages as domains: some entries are pinned, one domain has no rule and one a duration that can't be read."""
    i = F.col("doc_id")
    e = S.parquet(spark, d, "documents", "doc_id", "lang").select(i.alias("id"), F.col("lang").alias("domain"), F.lit(60.0).alias("ttl"), ((i % 10) / 10.0).alias("importance"), (i % 5 == 0).alias("ttl_pinned"), F.when(i % 7 == 0, True).alias("importance_pinned"))
    rules = spark.createDataFrame([("en", "2h", 0.3), ("fr", "2d", -0.4), ("de", "soon", 0.05)], "domain string, ttl string, delta double")
    return T.governed(e, rules).select("id", "ttl", F.round("importance", 6).alias("importance"))


@query("language_detect", "SELECT doc_id AS id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS language FROM documents")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), T.language(F.col("text")).alias("language"))


@query("topic_status", "SELECT user_id, CASE WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') <= 14 THEN 'ongoing' ELSE 'paused' END AS status FROM events GROUP BY 1")
def topic_status(spark: SparkSession, d: str) -> DataFrame:
    last = S.events(spark, d).groupBy("user_id").agg(F.max("t").alias("last"))
    return last.select("user_id", F.when(F.datediff(F.lit("2024-02-10").cast("date"), F.col("last").cast("date")) <= 14, "ongoing").otherwise("paused").alias("status"))


@query("ambiguity", "WITH r AS (SELECT user_id, value / 500.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, (max(s) FILTER (k = 1) < 0.7 OR max(s) FILTER (k = 1) - coalesce(max(s) FILTER (k = 2), 0) < 0.2) AS ambiguous FROM r WHERE k <= 2 GROUP BY 1")
def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """A best match that is weak, or not clearly ahead of the second."""
    from ..operators.scoring import top

    r = top(S.events(spark, d).withColumn("s", F.col("value") / 500.0), ["user_id"], 2, "s")
    best, second = F.max(F.when(F.col("rank") == 1, F.col("s"))), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("s"))), F.lit(0.0))
    return r.groupBy("user_id").agg(((best < 0.7) | (best - second < 0.2)).alias("ambiguous"))


@query("bbox_xywh", "SELECT event_id AS id, CASE WHEN user_id > 20 AND value > 10 THEN CAST(user_id - 20 AS DOUBLE) END AS w, CASE WHEN user_id > 20 AND value > 10 THEN round(value - 10, 6) END AS h FROM events")
def bbox_xywh(spark: SparkSession, d: str) -> DataFrame:
    b = T.xywh(F.array(F.lit(20.0), F.lit(10.0), F.col("user_id").cast("double"), F.col("value")))
    return S.events(spark, d).select("id", F.get(b, F.lit(2)).alias("w"), F.round(F.get(b, F.lit(3)), 6).alias("h"))


@query("json_props", "SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = S.parquet(spark, d, "events", "event_id", "props")
    return e.select(F.col("event_id").alias("id"), F.expr("variant_get(parse_json(props), '$.k', 'int')").alias("k"))


@query("mark_policy", "WITH m AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'rule' WHEN 2 THEN 'task' WHEN 3 THEN 'fact' ELSE 'other' END AS c, CASE event_id % 3 WHEN 0 THEN 'S1_ai_inference' WHEN 1 THEN 'S2_tool_grounded' ELSE 'S3_user_confirmed' END AS e, CASE event_type WHEN 'click' THEN 'Done' END AS s FROM events) SELECT id, CAST(86400 * CASE WHEN c IN ('preference', 'rule') THEN 0 WHEN c = 'fact' AND e <> 'S1_ai_inference' THEN 0 WHEN c = 'fact' THEN 180 WHEN c = 'task' AND s IS NOT NULL THEN 7 ELSE 30 END AS BIGINT) AS ttl, CASE WHEN c = 'preference' THEN 'until_changed' WHEN c = 'rule' OR c = 'fact' AND e <> 'S1_ai_inference' THEN 'permanent' ELSE 'temporary' END AS policy FROM m")
def mark_policy(spark: SparkSession, d: str) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ("preference", "rule", "task", "fact", "other"))), (F.col("id") % 5 + 1).cast("int"))
    evidence = F.element_at(F.array(*map(F.lit, ("S1_ai_inference", "S2_tool_grounded", "S3_user_confirmed"))), (F.col("id") % 3 + 1).cast("int"))
    return S.events(spark, d).select("id", T.mark_policy(category, evidence, F.when(F.col("action") == "click", "Done")).alias("m")).select("id", "m.ttl", "m.policy")


TALK = "SELECT conv_id, list(text ORDER BY turn, text) AS u FROM conversations WHERE text IS NOT NULL GROUP BY 1"


def _first_texts(turns: DataFrame, k: int) -> DataFrame:
    """(id, u): the first k texts of each session, however many it has; tasks send k rows of a session."""
    order = Window.partitionBy("session_id").orderBy("idx", "text")
    first = turns.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
    return first.groupBy(F.col("session_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("u"))


@query("window_digest", f"SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'given ' || conv_id WHEN conv_id % 3 = 1 AND len(trim(array_to_string(list_filter(list_slice(u, 1, 2), lambda x: len(trim(x)) > 0), ' '))) > 0 THEN array_to_string(list_filter(list_slice(u, 1, 2), lambda x: len(trim(x)) > 0), ' ') ELSE 'audio activity in ' || conv_id || '.0-' || (conv_id + 1) || '.5s' END AS summary FROM ({TALK})")
def window_digest(spark: SparkSession, d: str) -> DataFrame:
    """A third of conversations have a summary, a third their utterances, a third neither."""
    talk = _first_texts(S.turns(spark, d).filter("text IS NOT NULL"), 2)
    start = F.col("id").cast("double")
    summary = T.digest(F.when(F.col("id") % 3 == 0, F.concat(F.lit("given "), F.col("id").cast("string"))), F.when(F.col("id") % 3 == 1, F.col("u")).otherwise(F.array().cast("array<string>")), F.lit("audio"), start, start + 1.5)
    return talk.select("id", summary.alias("summary"))


@query("context_compaction", f"SELECT conv_id AS id, array_to_string(list_transform(list_slice(list_filter(u, lambda x: len(trim(x)) > 0), 1, 3), lambda x: CASE WHEN len(x) > 40 THEN rtrim(substr(x, 1, 39)) || '\u2026' ELSE x END), chr(10)) AS context FROM ({TALK})")
def context_compaction(spark: SparkSession, d: str) -> DataFrame:
    turns = S.turns(spark, d).filter("text IS NOT NULL")
    said = _first_texts(turns.filter(F.length(F.btrim("text")) > 0), 3)
    talk = turns.select(F.col("session_id").alias("id")).distinct().join(said, "id", "left").withColumn("u", F.coalesce("u", F.array().cast("array<string>")))
    return talk.select("id", F.array_join(T.compact(F.col("u"), 3, 40), "\n").alias("context"))
