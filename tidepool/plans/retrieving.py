"""Whole searches over embeddings, with documents as their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import timestamp
from ..operators import retrieval as R
from ..operators import scoring as O
from ..operators.nearest import nearest
from ..sources import tables as S
from .registry import query
from .scoring import COS, _queries, within

#: Questions by label.
QUESTIONS = ["When did the other open", "What kinds of that the", "What is the relationship status of Marta", "Who said that the"]
NOW = "2024-03-01"


def question(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QUESTIONS)), (label % len(QUESTIONS) + 1).cast("int"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Five routes of 50 candidates for each query. Hits with a score of 0 never count, so none is made where a score is rounded to it."""
    v, q = S.vectors(spark, d), _queries(spark, d)
    label = S.vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    near = lambda rows: nearest(q, rows.select("id", "vector"), 50).withColumn("score", F.round("cos", 9))
    known = within(v.select("id", "label"), label, 3200, "label").withColumn("score", F.round(F.pow(F.lit(0.5), F.abs(F.col("query_id") - F.col("id")) / 100.0), 9))
    # what is best for a label is among the 50 smallest ids of each label
    some = O.top(v.filter("id % 3 = 0").select("id", "label", F.lit(0).alias("score")), ["label"], 50).select("id", "label")
    asked = label.select(F.col("label").alias("ql")).distinct().join(some, F.lit(True)).withColumn("score", 1.0 / (1 + F.abs(F.col("ql") - F.col("label"))))
    met = label.withColumnRenamed("label", "ql").join(O.top(asked.drop("label"), ["ql"], 50).drop("rank"), "ql")
    routes = {"event_vec": near(v.filter("id % 2 = 0")), "vec": near(v), "knowledge": known, "entity": met, "time": within(v.select("id"), label, 20).withColumn("score", F.lit(0.7))}
    out = None
    for name, rows in routes.items():
        part = O.top(rows.select("query_id", "id", "score"), ["query_id"], 50).select("query_id", "id", F.lit(name).alias("route"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def _search(spark: SparkSession, d: str, **options) -> DataFrame:
    v = S.vectors(spark, d)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), question(F.col("label")).alias("question"))
    aliases = v.filter("id % 10 = 9").select(F.col("id").alias("alias"), (F.col("id") - 1).alias("canonical"))
    known = v.select("id", *((F.col("id") % m).cast("int").alias(n) for n, m in (("utterances", 5), ("knowledge", 4), ("entities", 3), ("slices", 2))))
    texts = S.entries(spark, d).select("id", "text", F.col("created_at").alias("t"))
    found = R.dialog_search(_hits(spark, d), asked, texts, 20, {"recency": 0.05, "signal": 0.02}, aliases=aliases, support=known, now=timestamp(NOW), **options)
    return found.select("query_id", "id", F.round("final", 6).alias("final"), F.round("preselect", 6).alias("preselect"), F.round("fidelity", 6).alias("fidelity"), F.round("signal", 6).alias("signal"), "routes", F.col("rank").cast("long").alias("rank"))


EDGE = r"[^\p{L}\p{M}\p{N}_]"
NAMED = f"regexp_extract_all(regexp_replace(coalesce(text, ''), '({EDGE})', '\\1\\1', 'g'), '(?:^|{EDGE})([A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})*)(?:$|{EDGE})', 1)"
TIMES = "today|yesterday|tomorrow|last|next|ago|years?|months?|weeks?|days?|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december"
HAS = "CASE WHEN list_contains(held, '{0}') THEN 1 ELSE 0 END"
IN = "CASE WHEN contains(low, '{0}') THEN 1 ELSE 0 END"


def _sum(kind: str, words: list[str]) -> str:
    return "(" + " + ".join(kind.format(w) for w in words) + ")"


#: What each question of QUESTIONS gives a text, written out.
FIDELITY = f"""CASE ql % 4 WHEN 0 THEN least({_sum(HAS, ["the", "other", "open"])}, 3) * 0.0015 + least({_sum(HAS, ["other"])}, 2) * 0.0015 + least({_sum(IN, ["the other", "other open"])}, 2) * 0.002 + CASE WHEN regexp_matches(low, '(^|{EDGE})(\\d{{4}}|\\d{{1,2}}[/-]\\d{{1,2}}([/-]\\d{{2,4}})?|{TIMES})($|{EDGE})') THEN 0.004 ELSE 0 END
 WHEN 1 THEN least({_sum(HAS, ["kinds", "that", "the"])}, 3) * 0.0015 + least({_sum(HAS, ["kinds"])}, 2) * 0.0015 + {_sum(IN, ["that the"])} * 0.002 + CASE WHEN regexp_matches(low, ',|(^|{EDGE})(and|or)($|{EDGE})') THEN 0.003 ELSE 0 END
 WHEN 2 THEN least({_sum(HAS, ["the", "relationship", "status"])}, 3) * 0.0015 + least({_sum(HAS, ["relationship", "status"])}, 2) * 0.0015 + least({_sum(IN, ["the relationship", "relationship status"])}, 2) * 0.002 + CASE WHEN regexp_matches(low, 'single|married|dating|divorced|engaged|partner|husband|wife|boyfriend|girlfriend') THEN 0.005 ELSE 0 END
 + CASE WHEN list_contains(named, 'marta') THEN 0.004 WHEN len(named) > 0 THEN -0.004 ELSE 0 END
 ELSE least({_sum(HAS, ["said", "that", "the"])}, 3) * 0.0015 + least({_sum(IN, ["said that", "that the"])}, 2) * 0.002 END"""
SLOT_OF = "CASE route WHEN 'event_vec' THEN 0.6 WHEN 'vec' THEN 0.6 WHEN 'knowledge' THEN 0.9 ELSE 0.15 END"
POOL = f"""WITH n AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS id, e.label, round({COS}, 9) AS cos, abs(q.vec_id - e.vec_id) AS apart FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
 c AS (SELECT query_id, ql, id, 'event_vec' AS route, cos AS score FROM n WHERE id % 2 = 0 UNION ALL SELECT query_id, ql, id, 'vec', cos FROM n UNION ALL SELECT query_id, ql, id, 'knowledge', round(pow(0.5, apart / 100.0), 9) FROM n WHERE label = ql
 UNION ALL SELECT query_id, ql, id, 'entity', CAST(1.0 / (1 + abs(ql - label)) AS DOUBLE) FROM n WHERE id % 3 = 0 UNION ALL SELECT query_id, ql, id, 'time', 0.7 FROM n WHERE apart <= 20),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, id) AS r FROM c), m AS (SELECT query_id, ql, CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS id, route, max(score) AS score FROM h WHERE r <= 50 AND score > 0 AND route IN (__ROUTES__) GROUP BY ALL),
 p AS (SELECT *, {SLOT_OF} AS w, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, id) AS r, max(score) OVER z AS hi, min(score) OVER z AS lo FROM m WINDOW z AS (PARTITION BY query_id, route)),
 f AS (SELECT query_id, ql, id, sum(w * (0.7 / (60 + r) + 0.3 * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END)) AS support, count(*) AS routes FROM p GROUP BY ALL),
 t AS (SELECT *, regexp_extract_all(low, '[a-z0-9'']+') AS held, list_filter(list_transform({NAMED}, lambda x: lower(x)), lambda x: x NOT IN ('what', 'when', 'where', 'who', 'why', 'would', 'how')) AS named FROM (SELECT doc_id AS id, text, lower(coalesce(text, '')) AS low FROM documents)),
 y AS (SELECT f.*, {FIDELITY} AS fidelity, round(support + fidelity + CASE WHEN t.id IS NULL THEN 0 ELSE __RECENCY__ * pow(0.5, 60 - f.id % 60) END, 9) AS preselect FROM f LEFT JOIN t ON t.id = f.id)"""
LAST = """, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, selection DESC, id) AS spot FROM x), s AS (SELECT *, __SIGNAL__ AS signal, round(selection + __WEIGHT__ * signal, 9) AS final FROM g WHERE spot <= 50), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, spot) AS rank FROM s)
 SELECT query_id, id, CAST(round(final, 6) AS DOUBLE) AS final, CAST(round(preselect, 6) AS DOUBLE) AS preselect, CAST(round(fidelity, 6) AS DOUBLE) AS fidelity, CAST(round(signal, 6) AS DOUBLE) AS signal, routes, rank FROM k WHERE rank <= 20"""
SIGNAL = "CASE WHEN spot <= 15 THEN 0.3 * least(id % 5, 3) + 0.4 * least(id % 4, 3) + 0.2 * least(id % 3, 3) + 0.1 * (id % 2) ELSE 0 END"
HEAD = """, o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY preselect DESC, id) <= 30 THEN 1 ELSE 0 END AS head, CASE WHEN id % 4 <> 0 AND abs(query_id - id) <= 100 THEN (id * 7 % 11) / 10.0 END AS model FROM y),
 u AS (SELECT *, min(preselect) OVER z AS a, max(preselect) OVER z AS b, min(model) OVER z AS ma, max(model) OVER z AS mb, count(*) OVER z AS nn, row_number() OVER (PARTITION BY query_id, head ORDER BY model DESC NULLS LAST, id) AS mr FROM o WINDOW z AS (PARTITION BY query_id, head)),
 x AS (SELECT *, CASE WHEN head = 0 THEN preselect ELSE round(0.25 * CASE WHEN a = b THEN 1 ELSE (preselect - a) / (b - a) END + 0.75 * CASE WHEN model IS NULL THEN CASE WHEN nn = 1 THEN 1 ELSE 0 END WHEN ma = mb THEN CASE WHEN nn = 1 THEN 1 ELSE 1 - (mr - 1) / (nn - 1) END ELSE (model - ma) / (mb - ma) END, 9) END AS selection FROM u)"""


def _sql(routes: str, recency: float, signal: str, weight: float, middle: str) -> str:
    return (POOL + middle + LAST).replace("__ROUTES__", routes).replace("__RECENCY__", str(recency)).replace("__SIGNAL__", signal).replace("__WEIGHT__", str(weight))


@query("dialog_search", _sql("'event_vec', 'vec', 'knowledge', 'entity', 'time'", 0.05, SIGNAL, 0.02, HEAD))
def dialog_search(spark: SparkSession, d: str) -> DataFrame:
    """Five routes, fidelity, recency, outside scores for the first 30 and the signal of what is known."""
    v = S.vectors(spark, d).select("id")
    n = within(v, v.filter("id % 50 = 0").select(F.col("id").alias("query_id")), 100).filter("id % 4 <> 0")
    return _search(spark, d, outside=n.select("query_id", "id", ((F.col("id") * 7 % 11) / 10.0).alias("model")), how=R.Rerank("blend", 30))


@query("dialog_ablation", _sql("'event_vec', 'vec', 'knowledge', 'time'", 0.0, "0.0", 0.0, ", x AS (SELECT *, 0 AS head, preselect AS selection FROM y)"))
def dialog_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The same without a route, without recency and without what is known."""
    return _search(spark, d, without=R.Ablation(["entity"], ["recency", "graph_signal"]))


WORDS = ["when did the other open", "what kinds of that the", "what is the relationship status of marta", "who said that the"]
SEARCH = f"""WITH q AS (SELECT vec_id AS query_id, embedding, CASE label % 4 {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))} END AS text, lang AS ql, source AS qs FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0),
 e AS (SELECT doc_id AS id, embedding, text, lang, source FROM documents LEFT JOIN embeddings ON doc_id = vec_id), ev AS (SELECT vec_id AS id FROM embeddings),
 cs AS (SELECT query_id, id, round({COS}, 9) AS score, CASE WHEN lang = ql AND source = qs THEN 0 WHEN lang = ql THEN 1 ELSE 2 END AS scope FROM e, q), lw AS (SELECT *, CASE WHEN score >= 0.3 THEN 0 ELSE 1 END AS low FROM cs),
 fi AS (SELECT query_id, min(low * 10 + scope) AS first FROM lw GROUP BY 1), dn AS (SELECT query_id, id, score, scope, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM lw JOIN fi USING (query_id) WHERE low * 10 + scope = first), dense AS (SELECT * FROM dn WHERE n <= 10),
 qa AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(string_split(text, ' ')) AS token FROM q) GROUP BY ALL),
 dd AS (SELECT id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS tokens FROM e), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dd),
 tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM dd) WHERE token IN (SELECT token FROM qa) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 bs AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS b FROM tf JOIN df USING (token) JOIN qa USING (token), st GROUP BY ALL),
 us AS (SELECT query_id, first % 10 AS used FROM fi), bi AS (SELECT query_id, id, b, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS n FROM bs JOIN e USING (id) JOIN q USING (query_id) JOIN us USING (query_id) WHERE b > 0 AND CASE WHEN e.lang = ql AND e.source = qs THEN 0 WHEN e.lang = ql THEN 1 ELSE 2 END <= used),
 po AS (SELECT query_id, id, d.score AS v, w.b FROM dense d FULL JOIN bi w USING (query_id, id) WHERE d.id IS NOT NULL OR w.n <= 50),
 co AS (SELECT a.src AS id, sum(a.g) AS g FROM (SELECT id AS src, 0.8 AS g FROM ev WHERE id + 1 IN (SELECT id FROM ev) UNION ALL SELECT id, 0.8 FROM ev WHERE id - 1 IN (SELECT id FROM ev) UNION ALL SELECT id, 0.2 FROM ev WHERE id + 7 IN (SELECT id FROM ev) UNION ALL SELECT id, 0.2 FROM ev WHERE id - 7 IN (SELECT id FROM ev)) a GROUP BY 1),
 nv AS (SELECT po.*, CASE WHEN max(greatest(v, 0)) OVER z <= 0 OR v IS NULL THEN 0 WHEN max(greatest(v, 0)) OVER z = min(CASE WHEN v IS NOT NULL THEN greatest(v, 0) END) OVER z THEN 1 ELSE (greatest(v, 0) - min(CASE WHEN v IS NOT NULL THEN greatest(v, 0) END) OVER z) / (max(greatest(v, 0)) OVER z - min(CASE WHEN v IS NOT NULL THEN greatest(v, 0) END) OVER z) END AS vn, coalesce(ln(1 + b) / max(ln(1 + b)) OVER z, 0) AS bn FROM po WINDOW z AS (PARTITION BY query_id)),
 sc AS (SELECT nv.*, lang = ql AS same, used, round(0.6 * vn + 0.25 * bn + 0.1 * coalesce(g, 0) + 0.05 * pow(0.5, 60 - nv.id % 60) + CASE WHEN lang = ql THEN 0.1 ELSE 0 END, 9) AS score FROM nv JOIN e USING (id) JOIN q USING (query_id) JOIN us USING (query_id) LEFT JOIN co USING (id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) SELECT query_id, id, rank, CAST(round(score, 6) AS DOUBLE) AS score, CAST(used AS INTEGER) AS scope FROM k WHERE rank <= 10"""


@query("hybrid_search", SEARCH)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and words of the narrowest language and source that has near ones, with neighbours by id, age, and a boost for the language."""
    doc = S.entries(spark, d).select("id", "text", F.col("memory_domain").alias("domain"), F.col("tenant_id").alias("source"), F.col("created_at").alias("t"))
    e = doc.join(S.vectors(spark, d), "id", "left")
    q = e.filter("id % 50 = 0 AND vector IS NOT NULL").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"), question(F.col("label")).alias("text"), F.col("domain").alias("q_domain"), F.col("source").alias("q_source"))
    ids = S.vectors(spark, d).select("id")
    links = ids.select(F.col("id").alias("src_id"), F.explode(F.array(F.struct((F.col("id") + 1).alias("dst_id"), F.lit("temporal_next").alias("rel_type"), F.lit(1.0).alias("weight")), F.struct((F.col("id") + 7).alias("dst_id"), F.lit("co_occurs").alias("rel_type"), F.lit(0.5).alias("weight")))).alias("x")).select("src_id", "x.*")
    edges = links.join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    w = O.HybridWeights(domain=0.1)
    found = R.hybrid_search(q, e.drop("label"), edges, 10, [["domain", "source"], ["domain"], []], timestamp(NOW), w, 0.3, True, hops=1)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "scope")


@query("dialog_routes", f"""WITH v AS (SELECT vec_id AS id, embedding, label FROM embeddings), q AS (SELECT id AS query_id, embedding, label, id AS mid FROM v WHERE id % 50 = 0),
 cs AS (SELECT q.query_id, e.id, round({COS}, 9) AS score FROM v e, q), r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, id % 3 ORDER BY score DESC, id) AS n FROM cs),
 h AS (SELECT query_id, id, 'event_vec' AS route, score FROM r1 WHERE id % 3 = 0 AND n <= 20 UNION ALL SELECT query_id, id - 1, 'vec', score FROM r1 WHERE id % 3 = 1 AND n <= 20 UNION ALL SELECT query_id, id - 2, 'knowledge', score FROM r1 WHERE id % 3 = 2 AND n <= 20
 UNION ALL SELECT query_id, v.id, 'entity', count(*) / 2.0 FROM q JOIN v ON v.id % 3 = 0 JOIN (SELECT 0 AS k UNION ALL SELECT 1) ON (q.label + k) % 10 IN (v.label, (v.label + 3) % 10) GROUP BY 1, 2
 UNION ALL SELECT query_id, v.id, 'time', round(1 - 0.5 * abs(v.id - mid) / 20.0, 9) FROM q JOIN v ON v.id % 3 = 0 AND abs(v.id - mid) <= 20),
 b AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, id) AS n FROM h) SELECT query_id, id, route, CAST(score AS DOUBLE) AS score FROM b WHERE n <= 20""")
def dialog_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every third vector is an event, the next one its utterance and the one after a fact; labels are people, ids are minutes."""
    v = S.vectors(spark, d)
    label = lambda k: ((F.col("label") + k) % 10).cast("string")
    minute = timestamp("2024-01-01") + F.make_dt_interval(mins=F.col("id").cast("int"))
    e, u, f = (v.filter(F.col("id") % 3 == k) for k in range(3))
    edge = lambda rows, a, b, rel: rows.select(a.cast("string").alias("src_id"), b.cast("string").alias("dst_id"), F.lit(rel).alias("rel_type"))
    i = F.col("id")
    edges = edge(u, i - 1, i, "SUPPORTED_BY").union(edge(f, i, i - 2, "DERIVED_FROM")).union(edge(e, i, label(0), "INVOLVES")).union(edge(e, i, label(3), "INVOLVES"))
    # ids are text in a graph: numbers of one length keep their order
    wide = lambda c: F.lpad(c.cast("string"), 9, "0")
    edges = edges.select(F.when(F.col("rel_type") != "", wide(F.col("src_id"))).alias("src_id"), F.when(F.col("rel_type") == "INVOLVES", F.col("dst_id")).otherwise(wide(F.col("dst_id"))).alias("dst_id"), "rel_type")
    q = v.filter("id % 50 = 0").select(i.alias("query_id"), F.col("vector").alias("qvec"), F.array(label(0), label(1)).alias("people"), (minute - F.expr("INTERVAL 20 MINUTES")).alias("t_from"), (minute + F.expr("INTERVAL 20 MINUTES")).alias("t_to"))
    e, u, f = (rows.withColumns({"t": minute, "id": wide(i)}) for rows in (e, u, f))
    return R.dialog_routes(q, e, u, f, edges, 20, bucket="HOUR").withColumn("id", F.col("id").cast("long"))
