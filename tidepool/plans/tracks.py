"""Media tracks, made of users' events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, media
from ..sources import tables as S
from .ranking import SPANS, spans
from .registry import query
from .scoring import COS

MS = "m AS (SELECT user_id % 10 AS source_id, event_type, event_id, a, b FROM s)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).withColumn("source_id", F.col("user_id") % 10)


FACE_VOICE = f"WITH {SPANS}, {MS}, x AS (SELECT source_id, event_type || source_id AS speaker, a, b FROM m WHERE event_id % 2 = 0), y AS (SELECT source_id, event_type AS track, a, b FROM m WHERE event_id % 2 = 1), p AS (SELECT x.source_id, speaker, track, sum(least(x.b, y.b) - greatest(x.a, y.a)) AS seconds, sum(x.b - x.a) AS length, count(*) AS turns FROM x JOIN y ON x.source_id = y.source_id AND x.a < y.b AND y.a < x.b WHERE least(x.b, y.b) - greatest(x.a, y.a) >= 0.4 GROUP BY ALL) SELECT source_id, speaker, track, round(seconds, 6) AS seconds, round(0.75 * least(1.0, seconds / length) + 0.25 * turns / max(turns) OVER (PARTITION BY source_id, speaker), 6) AS score FROM p"


@query("face_voice_pairs", FACE_VOICE)
def face_voice_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    x = s.filter("id % 2 = 0").select("source_id", F.concat("action", F.col("source_id").cast("string")).alias("speaker"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    y = s.filter("id % 2 = 1").select("source_id", F.col("action").alias("track"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return media.associate(x, y, width=100.0)


GREEDY = """WITH RECURSIVE fv AS (__PAIRS__), m AS (SELECT DISTINCT source_id, [] :: VARCHAR[] AS ls, [] :: VARCHAR[] AS rs, NULL :: VARCHAR AS speaker, NULL :: VARCHAR AS track, NULL :: DOUBLE AS score FROM fv
 UNION ALL SELECT source_id, list_append(ls, speaker), list_append(rs, track), speaker, track, score FROM (SELECT m.source_id, m.ls, m.rs, fv.speaker, fv.track, fv.score, row_number() OVER (PARTITION BY m.source_id ORDER BY fv.score DESC, fv.speaker, fv.track) AS k FROM m JOIN fv ON fv.source_id = m.source_id AND NOT list_contains(m.ls, fv.speaker) AND NOT list_contains(m.rs, fv.track)) WHERE k = 1)
 SELECT source_id, speaker, track, score FROM m WHERE speaker IS NOT NULL"""


@query("greedy_match", GREEDY.replace("__PAIRS__", FACE_VOICE))
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of each source, then the best of what is left."""
    return media.match_once(face_voice_pairs(spark, d).withColumn("verified", F.lit(False)))


@query("tracklet_stitch", """WITH RECURSIVE o AS (SELECT label AS seed, vec_id * 3.0 AS a, vec_id * 3.0 + 2 AS b, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
 f AS (SELECT seed, n, 0 AS part, a, b, b AS last, v AS s FROM o WHERE n = 1
 UNION ALL SELECT seed, n, CASE WHEN j THEN part ELSE part + 1 END, a, b, CASE WHEN j THEN greatest(last, b) ELSE b END, CASE WHEN j THEN list_transform(range(1, 65), lambda i: s[i] + v[i]) ELSE v END
 FROM (SELECT o.seed, o.n, f.part, o.a, o.b, f.last, f.s, o.v, o.a - f.last <= 2 OR list_dot_product(f.s, o.v) / sqrt(list_dot_product(f.s, f.s) * list_dot_product(o.v, o.v)) >= 0.75 AS j FROM f JOIN o ON o.seed = f.seed AND o.n = f.n + 1))
 SELECT seed, CAST(part AS BIGINT) AS part, CAST(min(a) AS DOUBLE) AS start, CAST(max(b) AS DOUBLE) AS "end", count(*) AS tracks FROM f GROUP BY 1, 2""")
def tracklet_stitch(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    t = v.select(F.col("label").alias("seed"), F.col("id").alias("track"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 2).alias("end"), F.col("vector").alias("embedding"))
    return media.stitch(t)


FACES = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, vec_id // 200 AS source_id, embedding FROM embeddings), g AS (SELECT * FROM v WHERE id % 9 <> 0), l AS (SELECT e.id AS a, q.id AS b FROM g e JOIN g q USING (source_id) WHERE e.id <> q.id AND {COS} >= 0.5),
 r AS (SELECT id AS a, id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1) SELECT source_id, id, CAST(coalesce(cluster, -1) AS BIGINT) AS cluster FROM v LEFT JOIN c USING (id)"""


@query("face_clusters", FACES)
def face_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sources of two hundred detections, so that one doesn't grow with the table."""
    v = S.vectors(spark, d).select(F.floor(F.col("id") / 200).alias("source_id"), "id", F.col("vector").alias("embedding"), F.when(F.col("id") % 9 == 0, 0.5).otherwise(0.95).alias("detection_confidence"), F.lit(30.0).alias("quality_score"))
    return media.similar_faces(v, 0.5)


ALIGN = f"""WITH v AS (SELECT vec_id AS id, vec_id // 100 AS session_id, embedding FROM embeddings), h AS (SELECT session_id, e.id AS event_id, q.id AS idx FROM v e JOIN v q USING (session_id) WHERE e.id % 3 = 0 AND q.id % 3 > 0 AND {COS} >= 0.1),
 s AS (SELECT *, lead(idx, 2) OVER (PARTITION BY event_id ORDER BY idx) AS far FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY far - idx, idx) AS n FROM s WHERE far IS NOT NULL), c AS (SELECT event_id, count(*) AS hits, min(idx) AS low, max(idx) AS high FROM h GROUP BY 1)
 SELECT v.session_id, v.id AS event_id, coalesce(hits, 0) AS hits, CASE WHEN hits >= 3 THEN 'mapped' WHEN hits > 0 THEN 'weak' ELSE 'unmapped' END AS status, CASE WHEN hits >= 3 THEN b.idx ELSE low END AS first, CASE WHEN hits >= 3 THEN b.far ELSE high END AS last
 FROM v LEFT JOIN c ON c.event_id = v.id LEFT JOIN b ON b.event_id = v.id AND n = 1 WHERE v.id % 3 = 0"""


@query("turn_event_alignment", ALIGN)
def turn_event_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a hundred rows, so that the pairs of one don't grow with the table."""
    v = S.vectors(spark, d).select(F.floor(F.col("id") / 100).alias("session_id"), "id", "vector")
    return media.align(v.filter("id % 3 > 0").select("session_id", F.col("id").alias("idx"), "vector"), v.filter("id % 3 = 0").select("session_id", F.col("id").alias("event_id"), "vector"), 0.1)


@query("frame_times", "WITH c AS (SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS s, c_custkey + 2.2 AS e FROM customer), n AS (SELECT *, unnest(range(0, 5)) AS f FROM c) SELECT id, CAST(f AS INTEGER) AS frame, CAST(round(least(s + f / 2.0, e), 3) AS DOUBLE) AS \"at\" FROM n")
def frame_times(spark: SparkSession, d: str) -> DataFrame:
    c = S.parquet(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("start"), (F.col("c_custkey") + 2.2).alias("end"))
    return media.frame_times(c, F.lit(2.0), 50)


@query("face_voice_confidence", "SELECT event_id AS id, round(CASE WHEN event_type = 'view' THEN least(0.59, value / 500) ELSE greatest(0, least(1, 0.25 + 0.25 * value / 500 + 0.5 * (user_id % 10) / 10.0)) END, 6) AS confidence FROM events")
def face_voice_confidence(spark: SparkSession, d: str) -> DataFrame:
    asd = F.when(F.col("action") != "view", (F.col("user_id") % 10) / 10.0)
    return S.events(spark, d).select("id", F.round(media.confidence(F.col("value") / 500, asd), 6).alias("confidence"))


@query("window_payload", f"WITH {SPANS}, {MS}, w AS (SELECT source_id, n AS \"window\", n * 86400.0 AS a, (n + 1) * 86400.0 AS b FROM (SELECT DISTINCT source_id FROM m), (SELECT unnest(range(CAST(floor(min(a) / 86400) AS BIGINT), CAST(floor(max(b) / 86400) AS BIGINT) + 1)) AS n FROM m)), h AS (SELECT w.source_id, w.\"window\", event_id, row_number() OVER (PARTITION BY w.source_id, w.\"window\" ORDER BY m.a, event_id) AS k FROM w JOIN m ON w.source_id = m.source_id AND w.a <= m.b AND m.a <= w.b) SELECT source_id, \"window\", string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS items FROM h WHERE k <= 5 GROUP BY 1, 2")
def window_payload(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    days = s.agg(F.floor(F.min("start") / 86400).alias("first"), F.floor(F.max("end") / 86400).alias("last")).select(F.explode(F.sequence("first", "last")).alias("window"))  # one row of bounds
    w = s.select("source_id").distinct().join(F.broadcast(days), F.lit(True))
    w = w.select("source_id", "window", (F.col("window") * 86400.0).alias("a_start"), ((F.col("window") + 1) * 86400.0).alias("a_end"))
    out = media.window_payload(w, s.select("source_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("id").alias("item")), 86400.0, 5)
    return out.select("source_id", "window", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("speech_turns", f"WITH {SPANS}, {MS}, x AS (SELECT source_id, event_type AS speaker, a, b FROM m WHERE event_id % 2 = 0), y AS (SELECT source_id, event_id, a, b FROM m WHERE event_id % 2 = 1), j AS (SELECT x.source_id, speaker, x.a AS t, greatest(x.a, y.a) AS s, least(x.b, y.b) AS e, CAST(event_id AS VARCHAR) AS text FROM x JOIN y ON x.source_id = y.source_id AND x.a < y.b AND y.a < x.b) SELECT source_id, speaker, text, CAST(round(s * 1e6) AS BIGINT) AS \"start\", CAST(round(e * 1e6) AS BIGINT) AS \"end\" FROM (SELECT * FROM j UNION ALL SELECT source_id, speaker, a, a, greatest(b, a + 1), '(audio)' FROM x WHERE (source_id, speaker, a) NOT IN (SELECT (source_id, speaker, t) FROM j))")
def speech_turns(spark: SparkSession, d: str) -> DataFrame:
    from .ranking import micros

    s = _sources(spark, d)
    x = s.filter("id % 2 = 0").select("source_id", F.col("action").alias("speaker"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    y = s.filter("id % 2 = 1").select("source_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("id").cast("string").alias("text"))
    return media.speaker_tracks(x, y, 100.0).select("source_id", "speaker", "text", micros("start").alias("start"), micros("end").alias("end"))


@query("external_sources", "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 > 1 THEN source END AS source FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 > 1")
def external_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two of five documents come from inside; those without a source don't."""
    docs = S.parquet(spark, d, "documents", "doc_id", "source").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 > 0, F.when(F.col("doc_id") % 5 == 0, filters.INTERNAL_SOURCES[0]).when(F.col("doc_id") % 5 == 1, filters.INTERNAL_SOURCES[-1]).otherwise(F.col("source"))).alias("source"))
    return docs.filter(filters.external())


@query("edge_label_check", "SELECT 'SUPPLIED_BY' AS rel_type, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 3 > 0) UNION ALL SELECT 'LIVES_IN', count(*) FROM customer")
def edge_label_check(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose relation isn't one of the typed graph, by relation; suppliers' nations and a third of the supplies have one that is."""
    from ..schema import RELATIONS

    third = (F.col("rel_type") == "SUPPLIED_BY") & (F.substring("src_id", 2, 20).cast("long") % 3 == 0)
    named = S.edges(spark, d).withColumn("rel_type", F.when(F.col("rel_type") == "BASED_IN", "OCCURS_AT").when(third, "INVOLVES").otherwise(F.col("rel_type")))
    return named.filter(~F.col("rel_type").isin(*RELATIONS)).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
