"""Texts held against vocabularies: topics by rules and synonyms, names of properties, repaired marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names as N
from ..operators import repair as R
from ..operators import topics as O
from ..sources import tables as S
from .registry import query


@query("topic_rules", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
 r AS (SELECT a.w AS w1, b.w AS w2, (len(a.w) * 7 + len(b.w) * 3) % 10 AS pr, row_number() OVER (ORDER BY a.w, b.w) AS place FROM w a JOIN w b ON a.w <> b.w AND (len(a.w) + len(b.w)) % 3 = 0),
 e AS (SELECT p_partkey AS id, p_name, p_brand, p_type, CASE WHEN p_size % 5 = 0 THEN p_type ELSE '' END AS tid, CASE WHEN p_size % 7 = 0 AND p_type <> 'SMALL' THEN 'own/' || p_type END AS own FROM part),
 t AS (SELECT *, p_name || CASE WHEN tid <> '' THEN ' ' || tid ELSE '' END || ' ' || p_brand AS text FROM e),
 m AS (SELECT id, arg_min(w1, place - pr * 100000) AS w1, arg_min(w2, place - pr * 100000) AS w2 FROM t JOIN r ON contains(text, w1) AND contains(text, w2) WHERE own IS NULL GROUP BY id),
 y AS (SELECT v, c, row_number() OVER (ORDER BY k, v) AS place FROM (SELECT DISTINCT 1 AS k, p_brand AS v, 'syn/' || p_brand AS c FROM part WHERE CAST(right(p_brand, 1) AS INT) % 2 = 0 UNION SELECT DISTINCT 2, p_type, 'own/' || p_type FROM part WHERE p_type <> 'SMALL')),
 x AS (SELECT id, arg_min(c, place) AS c FROM t JOIN y ON contains(text, v) GROUP BY id),
 b AS (SELECT id, min(CASE WHEN contains(text, w) AND w LIKE 'r%' THEN 'b/one' WHEN contains(text, w) AND w LIKE 'b%' THEN 'b/two' END) AS b FROM t, w GROUP BY id)
 SELECT t.id, coalesce(own, CASE WHEN len(m.w1) <> 4 THEN m.w1 || '/' || m.w2 END, CASE WHEN tid <> '' AND p_type <> 'SMALL' THEN 'own/' || p_type END, CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 0 THEN 'syn/' || p_brand END, x.c, b, '_uncategorized/general') AS topic_path,
 array_to_string(CASE WHEN m.w1 IS NOT NULL AND len(m.w2) % 2 = 0 THEN [m.w1] ELSE list_filter([p_type, 'x'], lambda z: z = 'x' OR len(z) = 5) END, ',') AS tags FROM t LEFT JOIN m USING (id) LEFT JOIN x USING (id) LEFT JOIN b USING (id)""")
def topic_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as events: a rule for many pairs of the words in their names, synonyms for brands and types, and two buckets."""
    part = S.parquet(spark, d, "part")
    distinct = lambda c: sorted(r[0] for r in part.select(c).distinct().collect())
    words, brands, types = distinct(F.explode(F.split("p_name", " "))), distinct("p_brand"), distinct("p_type")
    pairs = [(a, b) for a in words for b in words if a != b and (len(a) + len(b)) % 3 == 0]
    rules = [{"priority": (len(a) * 7 + len(b) * 3) % 10, "match": {"places": [a], "keywords_any": [b]}, "output": {"topic_path": f"{a}/{b}", "tags": [a, "no such tag"] if len(b) % 2 == 0 else []}} for a, b in pairs]
    synonyms = [{"canonical": f"syn/{b}", "variants": [b]} for b in brands] + [{"canonical": f"own/{t}", "variants": [t]} for t in types]
    paths = [f"{a}/{b}" for a, b in pairs if len(a) != 4] + [f"own/{t}" for t in types if t != "SMALL"] + [f"syn/{b}" for b in brands if int(b[-1]) % 2 == 0]
    v = O.vocabulary(spark, paths, [*words, "x", *(t for t in types if len(t) == 5)], rules, synonyms, {"b/one": [w for w in words if w[0] == "r"], "b/two": [w for w in words if w[0] == "b"]})
    own = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("own/"), "p_type")).when(F.col("p_size") % 11 == 0, "no/such/path")
    e = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("summary"), F.lit(None).cast("string").alias("desc"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("topic_id"), own.alias("topic_path"), F.array("p_brand").alias("keywords"), F.array("p_type", F.lit("x")).alias("tags"))
    return O.normalise(e, v).select("id", "topic_path", F.array_join("tags", ",").alias("tags"))


KINDS = ["fact", "preference", "odd", "task", ""]


@query("mark_repair", """WITH t AS (SELECT conv_id AS c, turn, conv_id || '-' || turn AS i, role, text FROM conversations), m AS (SELECT *, c % 10 > 0 AS there, coalesce(CASE WHEN c % 11 > 0 THEN c % 3 > 0 END, false) AS asked, c % 6 = 0 AS saved, ['fact', 'preference', 'odd', 'task', 'note'][c % 5 + 1] AS cat,
 CASE c % 4 WHEN 1 THEN 0.25 WHEN 2 THEN 7.0 END AS imp, CASE WHEN c % 4 < 3 THEN turn END AS s, CASE WHEN c % 9 > 0 THEN turn + c % 400 END AS e FROM t WHERE (c + turn) % 2 = 0),
 g AS (SELECT *, CASE WHEN asked AND cat = 'odd' THEN 'note' ELSE cat END AS good, CASE WHEN NOT there THEN 'S1_ai_inference' WHEN role = 'user' THEN 'S0_user_claim' WHEN role = 'tool' THEN 'S2_tool_grounded' ELSE 'S1_ai_inference' END AS ev, s >= 0 AND e > s AND e <= CASE WHEN there THEN length(text) ELSE 0 END AS ok FROM m),
 h AS (SELECT *, CASE good WHEN 'fact' THEN 'profile' WHEN 'preference' THEN 'profile' WHEN 'task' THEN 'commitment' ELSE 'user_pinned_note' END AS sub FROM g)
 SELECT i AS mark_id, asked OR saved AS keep, CASE WHEN ok THEN s END AS span_start, good AS category, CASE WHEN c % 13 > 0 OR asked THEN sub ELSE 'bad' END AS subtype, CASE WHEN c % 17 > 0 OR asked THEN ev ELSE 'S9' END AS evidence_level, CAST(CASE WHEN saved THEN greatest(0.9, least(1, coalesce(imp, 0.5))) ELSE least(1, coalesce(imp, 0.5)) END AS DOUBLE) AS importance,
 CASE WHEN saved OR good = 'preference' OR (good = 'fact' AND ev = 'S2_tool_grounded') THEN 0 WHEN good = 'fact' THEN 180 ELSE 30 END * 86400 AS ttl_seconds, CASE WHEN saved THEN 'permanent' WHEN good = 'preference' THEN 'until_changed' WHEN good = 'fact' AND ev = 'S2_tool_grounded' THEN 'permanent' ELSE 'temporary' END AS forget_policy,
 array_to_string(list_filter([CASE WHEN NOT there THEN 'unknown_turn_id' END, CASE WHEN c % 11 = 0 THEN 'keep_invalid' END, CASE WHEN (s IS NULL) <> (e IS NULL) THEN 'span_invalid' END, CASE WHEN s IS NOT NULL AND e IS NOT NULL AND NOT ok THEN 'span_range' END, CASE WHEN asked AND cat = 'odd' THEN 'category_invalid' END,
 CASE WHEN asked AND c % 13 = 0 THEN 'subtype_invalid' END, CASE WHEN asked AND c % 17 = 0 THEN 'evidence_invalid' END, CASE WHEN c % 4 = 3 THEN 'importance_invalid' END, CASE WHEN c % 4 = 2 THEN 'importance_range' END], lambda x: x IS NOT NULL), ',') AS errors, there AS keep_row FROM h""")
def mark_repair(spark: SparkSession, d: str) -> DataFrame:
    """Marks on half of the turns, with faults of every kind."""
    c, turn = F.col("conv_id"), F.col("turn").cast("int")
    t = S.parquet(spark, d, "conversations").withColumn("turn_id", F.concat_ws("-", c.cast("string"), F.col("turn").cast("string")))
    m = t.filter((c + F.col("turn")) % 2 == 0).select(
        F.col("turn_id").alias("mark_id"), F.when(c % 10 == 0, F.concat(F.lit("x"), "turn_id")).otherwise(F.concat(F.lit(" "), "turn_id")).alias("turn_id"), F.when(c % 11 > 0, c % 3 > 0).alias("keep"), F.when(c % 4 < 3, turn).alias("span_start"),
        F.when(c % 9 > 0, (turn + c % 400).cast("int")).alias("span_end"), F.element_at(F.array(*map(F.lit, KINDS)), (c % 5 + 1).cast("int")).alias("category"), F.when(c % 13 == 0, "bad").alias("subtype"), F.when(c % 17 == 0, "S9").alias("evidence_level"),
        F.when(c % 4 == 1, "0.25").when(c % 4 == 2, "7").when(c % 4 == 3, "much").alias("importance"), F.when(c % 6 == 0, True).alias("saved"), F.lit(None).cast("string").alias("status"),
    )
    out = R.marks(m, t.select("turn_id", "role", "text"))
    return out.select("mark_id", "keep", "span_start", "category", "subtype", "evidence_level", "importance", "ttl_seconds", "forget_policy", F.array_join("errors", ",").alias("errors"), "keep_row")


@query("event_repair", """WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS s, CASE o_orderkey % 3 WHEN 0 THEN 'Composite' WHEN 1 THEN 'Odd' ELSE 'Atomic' END AS y, CASE WHEN o_orderkey % 5 = 0 THEN 'strange' ELSE 'weak' END AS st, o_totalprice / 300000 - 0.1 AS conf, o_custkey % 25 AS n FROM orders)
 SELECT k AS event_id, s AS summary, CASE WHEN y = 'Odd' THEN 'Atomic' ELSE y END AS event_type, CASE WHEN n % 2 > 0 THEN 'unmapped' WHEN st = 'strange' THEN 'mapped' ELSE st END AS status, CAST(round(greatest(0, least(1, conf)), 6) AS DOUBLE) AS confidence, CASE WHEN n % 2 = 0 THEN 'n' || n ELSE '' END AS turn_ids, CAST(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS evidence_count,
 array_to_string(list_filter([CASE WHEN s = '' THEN 'summary_missing' END, CASE WHEN y = 'Odd' THEN 'event_type_invalid' END, 'unknown_turns', CASE WHEN st = 'strange' THEN 'status_invalid' END, CASE WHEN conf < 0 OR conf > 1 THEN 'confidence_range' END], lambda x: x IS NOT NULL), ',') AS errors, s <> '' AS keep_row FROM e""")
def event_repair(spark: SparkSession, d: str) -> DataFrame:
    """Orders as extracted events that name two turns each, of which one at most is known."""
    k = F.col("o_orderkey")
    e = S.parquet(spark, d, "orders").select(
        k.alias("event_id"), F.when(k % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("summary"), F.when(k % 3 == 0, "Composite").when(k % 3 == 1, "Odd").alias("event_type"), F.when(k % 5 == 0, "strange").otherwise("Weak").alias("status"),
        (F.col("o_totalprice") / 300000 - 0.1).alias("confidence"), F.array(F.lit("zz"), F.concat(F.lit(" n"), (F.col("o_custkey") % 25).cast("string"))).alias("turn_ids"),
    )
    n = S.parquet(spark, d, "nation", "n_nationkey").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("turn_id"))
    # a half of the sixth digit is one of the product, as in SQL; round() to six digits would go by the decimal digits of the number
    return R.events(e, n).withColumns({"confidence": F.round(F.col("confidence") * 1e6) / 1e6, "turn_ids": F.array_join("turn_ids", ","), "errors": F.array_join("errors", ",")})


@query("state_repair", """WITH s AS (SELECT c_custkey AS k, c_name, CASE c_custkey % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'job' WHEN 2 THEN 'unknown' ELSE '' END AS p, c_mktsegment AS v, c_custkey % 9 = 0 AS neg, c_nationkey % 2 = 0 AS ok FROM customer),
 o AS (SELECT *, (p = 'segment' AND v NOT IN ('BUILDING', 'MACHINERY')) OR (p = 'job' AND v <> 'MACHINERY') AS outside FROM s)
 SELECT k AS state_id, p AS property, CASE WHEN outside AND p = 'segment' THEN '_other' ELSE v END AS value, CASE WHEN outside AND p = 'segment' THEN v END AS raw_value,
 array_to_string(list_filter([CASE WHEN p = '' THEN 'incomplete' END, CASE WHEN neg THEN 'negated' END, CASE WHEN p = 'unknown' THEN 'property_unknown' END, CASE WHEN outside THEN 'value_outside' END, CASE WHEN NOT ok THEN 'no_known_turn' END], lambda x: x IS NOT NULL), ',') AS errors,
 p IN ('segment', 'job') AND NOT neg AND (NOT outside OR p = 'segment') AND ok AS keep_row FROM o""")
def state_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = S.parquet(spark, d, "customer").select(
        k.alias("state_id"), F.col("c_name").alias("subject"), F.when(k % 4 == 0, "segment").when(k % 4 == 1, "job").when(k % 4 == 2, "unknown").alias("property"), F.col("c_mktsegment").alias("value"), F.lit(None).cast("string").alias("raw_value"),
        (k % 9 == 0).alias("negated"), F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("turn_ids"),
    )
    n = S.parquet(spark, d, "nation", "n_nationkey").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("turn_id"))
    known = spark.createDataFrame([("segment", ["BUILDING", "MACHINERY"], True), ("job", ["MACHINERY"], False)], "property string, allowed array<string>, allow_raw boolean")
    return R.states(s, n, known).select("state_id", "property", "value", "raw_value", F.array_join("errors", ",").alias("errors"), "keep_row")


@query("name_ladder", """WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT p_brand AS alias, min(p_name) AS name FROM part GROUP BY 1), t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN p_brand WHEN 3 THEN substr(p_name, 1, 5) WHEN 4 THEN '- ' || split_part(p_name, ' ', 2) ELSE lower(p_brand) END AS text FROM part),
 r AS (SELECT id, coalesce(n.name, a.name, m.name, b.name) AS canonical, CASE WHEN n.name IS NOT NULL THEN 'canonical_exact' WHEN a.name IS NOT NULL THEN 'alias_exact' WHEN m.name IS NOT NULL THEN 'normalized_match' WHEN b.name IS NOT NULL THEN 'normalized_alias' END AS source, trim(regexp_replace(lower(text), '[ _-]+', ' ', 'g')) AS f
 FROM t LEFT JOIN n ON n.name = text LEFT JOIN a ON a.alias = text LEFT JOIN n m ON m.name = trim(regexp_replace(lower(text), '[ _-]+', ' ', 'g')) LEFT JOIN a b ON lower(b.alias) = trim(regexp_replace(lower(text), '[ _-]+', ' ', 'g'))),
 c AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY length(name), name) AS k, count(*) OVER (PARTITION BY id) AS n FROM r JOIN n ON r.source IS NULL AND contains(n.name, r.f)), l AS (SELECT id, max(n) AS n, string_agg(name, ',' ORDER BY k) AS c FROM c WHERE k <= 5 GROUP BY 1)
 SELECT id, source IS NOT NULL AS matched, source IS NULL AND coalesce(n, 0) > 1 AS ambiguous, canonical, CASE WHEN source IS NULL THEN coalesce(c, '') ELSE '' END AS candidates, source FROM r LEFT JOIN l USING (id)""")
def name_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts and their brands as aliases; texts are names, other spellings, aliases and pieces of names."""
    part, k = S.parquet(spark, d, "part", "p_partkey", "p_name", "p_brand"), F.col("p_partkey")
    text = F.when(k % 6 == 0, F.col("p_name")).when(k % 6 == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(k % 6 == 2, F.col("p_brand")).when(k % 6 == 3, F.substring("p_name", 1, 5)).when(k % 6 == 4, F.concat(F.lit("- "), F.split_part("p_name", F.lit(" "), F.lit(2)))).otherwise(F.lower("p_brand"))
    out = N.resolve(part.select(k.alias("id"), text.alias("text")), part.select(F.col("p_name").alias("name")), part.groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_name").alias("name")))
    return out.withColumn("candidates", F.array_join("candidates", ","))
