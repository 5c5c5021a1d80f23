"""Scans, sources, filters, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import timestamp
from ..functions import text as T
from ..operators import filters as O
from ..sources import tables as S
from ..sources.store import new_path
from .registry import query

ENTRIES = """WITH e AS (SELECT d.doc_id AS id, d.text, d.source AS tenant_id, d.lang AS memory_domain, (l.quality = 1) AS published,
 CASE WHEN l.toxic = 1 THEN 0.1 WHEN l.quality = 1 THEN 0.8 ELSE 0.5 END AS importance,
 TIMESTAMP '2024-01-01' + (d.doc_id % 60) * INTERVAL 1 DAY AS created_at, 'u' || (d.doc_id % 7) AS u1, 'u' || (d.doc_id % 11) AS u2
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query("corpus_scan", f"{ENTRIES} SELECT id, tenant_id, memory_domain FROM e WHERE tenant_id = 'src8' ORDER BY id LIMIT 500")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 entries of a tenant, by id."""
    return S.parquet(spark, d, "documents", "doc_id", "source", "lang").filter("source = 'src8'").select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), F.col("lang").alias("memory_domain")).orderBy("id").limit(500)


@query("point_get", "SELECT doc_id AS id, lang, source FROM documents WHERE doc_id = 17")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "doc_id", "lang", "source").filter("doc_id = 17").withColumnRenamed("doc_id", "id")


@query("composite_filter", f"{ENTRIES} SELECT id, tenant_id, memory_domain FROM e WHERE coalesce(published, true) AND memory_domain = 'en' AND (u1 IN ('u1','u2') OR u2 IN ('u1','u2')) AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-10'")
def composite_filter(spark: SparkSession, d: str) -> DataFrame:
    f = O.Filters(published=True, memory_domain="en", users=["u1", "u2"], start=timestamp("2024-01-05"), end=timestamp("2024-02-10"))
    rows = S.entries(spark, d).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    return rows.filter(f.column()).select("id", "tenant_id", "memory_domain")


@query("user_match_any", f"{ENTRIES} SELECT id FROM e WHERE u1 IN ('u3','u5') OR u2 IN ('u3','u5')")
def user_match_any(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).filter(O.users_match(["u3", "u5"])).select("id")


@query("user_match_all", f"{ENTRIES} SELECT id FROM e WHERE (u1 = 'u3' OR u2 = 'u3') AND (u1 = 'u5' OR u2 = 'u5')")
def user_match_all(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).filter(O.users_match(["u3", "u5"], "all")).select("id")


@query("published_tristate", f"{ENTRIES} SELECT 'true' AS flag, count(*) AS n FROM e WHERE published IS NOT FALSE UNION ALL SELECT 'false', count(*) FROM e WHERE published IS FALSE UNION ALL SELECT 'none', count(*) FROM e")
def published_tristate(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    counts = e.agg(*(F.count_if(O.published_is(v)).alias(k) for k, v in (("true", True), ("false", False), ("none", None))))
    return counts.unpivot([], ["true", "false", "none"], "flag", "n")


@query("soft_ttl", f"{ENTRIES} SELECT id FROM e WHERE coalesce(published, true) AND (importance >= 0.8 OR created_at + CASE WHEN importance >= 0.5 THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END > TIMESTAMP '2024-02-15')")
def soft_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    lasts = F.when(F.col("importance") >= 0.8, None).when(F.col("importance") >= 0.5, F.col("created_at") + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("created_at") + F.expr("INTERVAL 7 DAYS"))
    return e.withColumn("expires_at", lasts).filter(O.visible(timestamp("2024-02-15"))).select("id")


@query("time_range", "SELECT event_id AS id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "events", "event_id", "user_id", "ts").filter(O.in_range(timestamp("2024-01-10"), timestamp("2024-01-12"), "ts")).select(F.col("event_id").alias("id"), "user_id")


@query("topic_prefix_filter", "SELECT event_id AS id, 'activity/' || event_type AS topic_path FROM events WHERE starts_with('activity/' || event_type, 'activity/p')")
def topic_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).filter(O.topic_prefix("activity/p")).select("id", "topic_path")


@query("text_contains", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_contains(spark: SparkSession, d: str) -> DataFrame:
    return S.parquet(spark, d, "documents", "doc_id", "text", "source").filter(O.contains_text("LICENSE", "text", "source")).select(F.col("doc_id").alias("id"))


@query("scope_ladder", f"{ENTRIES}, t AS (SELECT id, CASE WHEN tenant_id = 'nowhere' AND memory_domain = 'en' THEN 0 WHEN memory_domain = 'es' AND u1 = 'u1' THEN 1 WHEN u1 = 'u1' THEN 2 ELSE 3 END AS scope_rank FROM e) SELECT id, scope_rank FROM t WHERE scope_rank = (SELECT min(scope_rank) FROM t)")
def scope_ladder(spark: SparkSession, d: str) -> DataFrame:
    user = O.users_match(["u1"]) & (F.get("user_id", F.lit(0)) == "u1")
    steps = [(F.col("tenant_id") == "nowhere") & (F.col("memory_domain") == "en"), (F.col("memory_domain") == "es") & user, user, F.lit(True)]
    return O.ladder(S.entries(spark, d), steps).select("id", "scope_rank")


@query("threshold_relax", "WITH s AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings) SELECT id, round(score, 6) AS score FROM s WHERE score >= 5 OR (SELECT max(score) FROM s) < 5")
def threshold_relax(spark: SparkSession, d: str) -> DataFrame:
    rows = S.vectors(spark, d).select("id", F.get("vector", F.lit(0)).cast("double").alias("score"))
    return O.at_least(rows, 5.0, relax=True).select("id", F.round("score", 6).alias("score"))


@query("gating_topk_edges", """WITH w AS (SELECT l_partkey, l_suppkey, count(*) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, 's' || l_suppkey) AS k FROM w)
SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, CAST(weight AS DOUBLE) AS weight FROM r WHERE k <= 3""")
def gating_topk_edges(spark: SparkSession, d: str) -> DataFrame:
    return O.strongest_edges(S.edges(spark, d).filter("rel_type = 'SUPPLIED_BY'"), 3).select("src_id", "dst_id", "weight")


@query("schema_invariants", "SELECT o_orderkey AS id, 'cheap' AS rule FROM orders WHERE o_totalprice <= 2000 UNION ALL SELECT o_orderkey, 'late' FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01'")
def schema_invariants(spark: SparkSession, d: str) -> DataFrame:
    return O.violations(S.order_events(spark, d), {"cheap": F.col("importance") > 2000, "late": F.col("t") <= timestamp("2001-07-01")})


@query("keyset_page", "SELECT DISTINCT l_orderkey AS subject, l_partkey AS object FROM lineitem WHERE (l_orderkey > 100) OR (l_orderkey = 100 AND l_partkey > 500) ORDER BY subject, object LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page after a composite key, so no subject is cut in two."""
    after = "(event_id > 100) OR (event_id = 100 AND entity_id > 500)"
    return S.involves(spark, d).filter(after).orderBy("event_id", "entity_id").limit(50).select(F.col("event_id").alias("subject"), F.col("entity_id").alias("object"))


@query("offset_page", "SELECT o_orderkey AS id, o_orderdate AS t FROM orders ORDER BY coalesce(o_orderdate, TIMESTAMP '1970-01-01'), o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return S.order_events(spark, d).select("id", "t").orderBy(F.coalesce("t", timestamp("1970-01-01")), "id").offset(40).limit(20)


@query("srot_export", """SELECT 'p' || l_partkey AS subject, 'SUPPLIED_BY' AS relation, 's' || l_suppkey AS object, max(l_shipdate) AS t FROM lineitem GROUP BY ALL ORDER BY subject, relation, object LIMIT 100""")
def srot_export(spark: SparkSession, d: str) -> DataFrame:
    """Triples with the time they were last seen."""
    rows = S.parquet(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_shipdate").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("subject"), F.lit("SUPPLIED_BY").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("object")).agg(F.max("l_shipdate").alias("t"))
    return rows.orderBy("subject", "relation", "object").limit(100)


@query("scene_dedup", """WITH s AS (SELECT l_orderkey % 50 AS a, l_quantity AS q, l_returnflag AS modality FROM lineitem) SELECT CAST(a AS DOUBLE) AS t_start_s, q AS t_end_s, modality FROM s WHERE q > a GROUP BY ALL""")
def scene_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = S.parquet(spark, d, "lineitem").select((F.col("l_orderkey") % 50).cast("double").alias("t_start_s"), F.col("l_quantity").alias("t_end_s"), F.col("l_returnflag").alias("modality"))
    return O.clean_scenes(s)


@query("entities_overlap", f"{ENTRIES} SELECT id FROM e WHERE u1 IN ('u1', 'u3') OR u2 IN ('u1', 'u3')")
def entities_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Entries that name one of some users."""
    return S.entries(spark, d).filter(O.any_of(["u1", "u3"], "user_id")).select("id")


@query("array_any", "SELECT p_partkey AS id FROM part WHERE p_partkey % 10 > 0 AND list_has_any(string_split(p_name, ' '), ['ring', 'red'])")
def array_any(spark: SparkSession, d: str) -> DataFrame:
    """A null array has none."""
    p = S.parquet(spark, d, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 > 0, F.split("p_name", " ")).alias("words"))
    return p.filter(O.any_of(["ring", "red"], "words")).select("id")


@query("named_floor", "SELECT p_partkey AS id, CASE WHEN p_retailprice - 901 <= 0 THEN 1.0 ELSE round(p_retailprice - 901, 6) END AS score FROM part WHERE p_partkey IN (0, 5, 40, 150)")
def named_floor(spark: SparkSession, d: str) -> DataFrame:
    p = S.parquet(spark, d, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") - 901, 6).alias("score"))
    return O.floor_named(p, [0, 5, 40, 150, -1])


@query("event_policy", "SELECT o_orderkey AS id, CAST(least(o_orderkey % 9 + 1, 5) AS INTEGER) AS turns, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 ELSE 7 END * 86400 AS DOUBLE) AS ttl FROM orders WHERE o_orderkey % 11 > 0 AND o_totalprice / 500000 >= 0.4")
def event_policy(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of some confidence (null for every eleventh) that rest on up to nine turns."""
    k = F.col("o_orderkey")
    e = S.parquet(spark, d, "orders", "o_orderkey", "o_totalprice").select(k.alias("id"), F.when(k % 11 > 0, F.col("o_totalprice") / 500000).alias("event_confidence"), F.when(k % 3 == 0, "mapped").when(k % 3 == 1, "weak").otherwise("unmapped").alias("evidence_status"), F.sequence(F.lit(0).cast("long"), k % 9).alias("source_turn_ids"))
    return O.event_policy(e, 0.4).select("id", F.size("source_turn_ids").alias("turns"), "ttl")


@query("segment_contained", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 100 AND c_acctbal + 50 <= 900")
def segment_contained(spark: SparkSession, d: str) -> DataFrame:
    c = S.parquet(spark, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("t_media_start"), (F.col("c_acctbal") + 50).alias("t_media_end"))
    return O.contained(c, 100.0, 900.0).select("id")


@query("name_squeeze", "SELECT p_partkey AS id, p_name || ' ' || p_brand AS name FROM part")
def name_squeeze(spark: SparkSession, d: str) -> DataFrame:
    p = S.parquet(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return p.select(F.col("p_partkey").alias("id"), T.squeeze(F.concat(F.lit(" \t"), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit("   "), "p_brand", F.lit(" "))).alias("name"))


@query("importance_map", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 0.9 WHEN o_orderpriority LIKE '3%' THEN 0.6 WHEN o_orderpriority LIKE '5%' THEN 0.3 END AS DOUBLE) AS importance FROM orders")
def importance_map(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    word = F.when(first == "1", "HIGH").when(first == "3", "Medium").when(first == "5", "low").when(first == "2", "odd")
    return S.parquet(spark, d, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderkey").alias("id"), T.importance(word).alias("importance"))


@query("time_ranges", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT id, CASE k WHEN 0 THEN d WHEN 1 THEN d - 3 WHEN 2 THEN date_trunc('month', d) WHEN 3 THEN date_trunc('year', d) WHEN 4 THEN DATE '2024-03-12' WHEN 5 THEN DATE '2024-03-04' WHEN 6 THEN DATE '2024-02-01' END::TIMESTAMP AS "start",
 CASE k WHEN 0 THEN d + 1 WHEN 1 THEN d + 1 WHEN 2 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 3 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 4 THEN DATE '2024-03-13' WHEN 5 THEN DATE '2024-03-11' WHEN 6 THEN DATE '2024-03-01' END::TIMESTAMP AS "end" FROM o""")
def time_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Questions about days, spans, months, years and days by name, asked on a Wednesday."""
    k, day = F.col("o_orderkey") % 8, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.concat(F.lit("what was on "), day.cast("string"), F.lit("?"))).when(k == 1, F.concat(F.lit("from "), day.cast("string"), F.lit(" to "), F.date_sub(day, 3).cast("string"))).when(k == 2, F.concat(F.lit("in "), F.date_format(day, "yyyy-M"))).when(k == 3, F.concat(F.lit("all of "), F.year(day).cast("string")))
    text = text.when(k == 4, "What did they say Yesterday").when(k == 5, "上周做了什么").when(k == 6, "last month please").otherwise("2024-13-77 or never")
    out = S.parquet(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), T.time_range(text, timestamp("2024-03-13 15:00:00")).alias("r"))
    return out.select("id", "r.start", "r.end")


@query("json_lines", "SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 5 > 0")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as JSON lines, every fifth of them broken, and read back."""
    t, path = S.parquet(spark, d, "conversations"), new_path(spark, "json-lines")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    t.select(F.when((F.col("conv_id") + F.col("turn")) % 5 > 0, line).otherwise(F.substring(line, 1, 9)).alias("value")).write.text(path)
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    return S.json_lines(spark, path, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text STRING")
